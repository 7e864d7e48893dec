"""Parameters of the operators. Defaults are fixed values of the data contract."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class AlertRules:
    # fixed values: alert thresholds
    rsi_overbought: float = 70.0
    rsi_oversold: float = 30.0
    rvol_spike: float = 3.0
    rvol_extreme: float = 5.0
    spike_multiplier: float = 2.0
    momentum_min_pct: float = 0.005
    timeframe: str = "1m"


@dataclass(frozen=True)
class NewsRules:
    # fixed values: sentiment window and label cut
    lookback_days: int = 14
    max_articles: int = 30
    fallback_articles: int = 10
    label_cut: float = 0.2
    top_drivers: int = 3


@dataclass(frozen=True)
class TradeRules:
    # fixed values: strategy defaults
    min_pred_a: float = 0.06
    max_risk: float = 0.30
    stop_loss: float = 0.06
    horizon: int = 14


@dataclass(frozen=True)
class RequestCaps:
    # fixed values: limits of a request
    max_symbols: int = 25
    max_days: int = 365


@dataclass(frozen=True)
class PortfolioRules:
    # fixed values: defaults of an account's constraints
    max_weight: float = 40.0
    min_cash: float = 0.0
    excluded: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()


# fixed values: fallback price/earnings by sector
SECTOR_PE = {
    "Technology": 30.0,
    "Communication Services": 24.0,
    "Consumer Cyclical": 22.0,
    "Consumer Defensive": 21.0,
    "Healthcare": 20.0,
    "Financial Services": 13.0,
    "Industrials": 22.0,
    "Energy": 12.0,
    "Utilities": 18.0,
    "Real Estate": 18.0,
    "Basic Materials": 16.0,
}

# fixed values: renamed tickers (empty = delisted)
SYMBOL_ALIASES = {
    "AGN": "ABBV",
    "BRK.B": "BRK-B",
    "CELG": "BMY",
    "FB": "META",
    "MON": "",
    "PCLN": "BKNG",
    "RTN": "RTX",
    "TWX": "",
    "UTX": "RTX",
    "WBA": "",
}

# fixed values: display names of market indicators
INDICATOR_NAMES = {
    "BTC-USD": "Bitcoin",
    "ETH-USD": "Ethereum",
    "CL=F": "WTI Crude Oil",
    "GC=F": "Gold",
    "SI=F": "Silver",
    "NG=F": "Natural Gas",
    "^DJI": "Dow Jones",
    "^GSPC": "S&P 500",
    "^IXIC": "Nasdaq Composite",
    "^RUT": "Russell 2000",
    "^VIX": "VIX",
    "VNINDEX": "VN-Index",
    "HNXINDEX": "HNX-Index",
    "UPCOMINDEX": "UPCoM-Index",
}

# fixed values: words that look like tickers (a caller adds the names of its own product), and claims that must not appear
NOT_TICKERS = ("I", "A", "THE", "AND", "OR", "FOR", "API", "SQL", "HTML", "CSS", "JSON", "CSV")
FORBIDDEN_CLAIMS = ("guaranteed profit", "risk-free", "certain return")

# fixed values: prefixes of source references that count as reliable
TRUSTED_PREFIXES = (
    "postgresql.", "spark.", "mongodb.", "nessie.", "raw.", "curated.", "ml_ready.", "bronze.", "silver.", "ml.",
    "alert.",
)


@dataclass(frozen=True)
class LinearScorer:
    """Fixed-coefficient stand-in for a trained model pair: upside is linear, risk is logistic."""

    upside_bias: float = 0.02
    upside: dict[str, float] = field(default_factory=lambda: {"CLV": 0.05, "BB_pctB": 0.03, "MFI14": 0.001})
    risk_bias: float = -1.0
    risk: dict[str, float] = field(default_factory=lambda: {"CLV": -1.5, "BB_pctB": 0.5, "MFI14": 0.01})
    version: str = "linear-a"
    risk_version: str = "logit-c"
