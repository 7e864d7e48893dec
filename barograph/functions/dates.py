"""US equity session calendar as SQL expressions over a date."""

from __future__ import annotations


def _nth(year: str, month: int, weekday: int, n: int) -> str:
    """n-th given weekday (0 = Monday) of a month."""
    first = f"make_date({year}, {month}, 1)"
    return f"date_add({first}, pmod({weekday} - weekday({first}), 7) + {7 * (n - 1)})"


def _observed(day: str) -> str:
    """Saturday holidays move to Friday, Sunday holidays to Monday."""
    return f"date_add({day}, case weekday({day}) when 5 then -1 when 6 then 1 else 0 end)"


def _good_friday(year: str) -> str:
    """Two days before Easter, by the Gauss-Lichtenberg formula."""
    century = f"({year} div 100)"
    secular = f"(15 + (3 * {century} + 3) div 4 - (8 * {century} + 13) div 25)"
    moon = f"((19 * ({year} % 19) + {secular}) % 30)"
    full = f"(21 + {moon} - ({moon} + ({year} % 19) div 11) div 29)"
    sunday = f"(7 - pmod({year} + {year} div 4 + 2 - (3 * {century} + 3) div 4, 7))"
    return f"date_add(make_date({year}, 3, 1), cast({full} + 7 - pmod({full} - {sunday}, 7) - 3 as int))"


def is_session(day: str) -> str:
    """SQL predicate: the exchange is open on this date."""
    y = f"year({day})"
    last_may = f"make_date({y}, 5, 31)"
    holidays = [
        _observed(f"make_date({y} + 1, 1, 1)"), _observed(f"make_date({y}, 1, 1)"), _nth(y, 1, 0, 3), _nth(y, 2, 0, 3),
        _good_friday(y), f"date_sub({last_may}, weekday({last_may}))", _observed(f"make_date({y}, 6, 19)"),
        _observed(f"make_date({y}, 7, 4)"), _nth(y, 9, 0, 1), _nth(y, 11, 3, 4), _observed(f"make_date({y}, 12, 25)")]
    return f"(weekday({day}) < 5 and {day} not in ({', '.join(holidays)}))"


def latest_session(day: str) -> str:
    """SQL expression: the last session on or before a date. No closure lasts ten days."""
    back = f"transform(sequence(0, 9), i -> date_sub({day}, i))"
    return f"filter({back}, d -> {is_session('d')})[0]"


def completed_candidate(ts: str, zone: str = "America/New_York", close: str = "16:15:00") -> str:
    """SQL expression: local date of a UTC time, or the day before while the session has not closed."""
    local = f"from_utc_timestamp({ts}, '{zone}')"
    return f"if(date_format({local}, 'HH:mm:ss') < '{close}', date_sub(to_date({local}), 1), to_date({local}))"
