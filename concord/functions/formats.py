"""Numbers for people: durations, bytes, percentages, counts."""

from __future__ import annotations

UNITS = ("bytes", "KiB", "MiB", "GiB", "TiB", "PiB")


def number(x: float, digits: int = 2) -> str:
    """With commas; a fraction has two digits, a whole number none."""
    if isinstance(x, int) or float(x).is_integer():
        return f"{int(x):,}"
    return f"{x:,.{digits}f}"


def duration(seconds: float) -> str:
    """Like 1d 2h 3m 4.56s; seconds have a fraction only if there is one."""
    sign, seconds = ("-" if seconds < 0 else ""), abs(round(seconds, 2))
    whole, parts = int(seconds), []
    for name, size in (("d", 86_400), ("h", 3_600), ("m", 60)):
        if whole >= size or parts:
            parts.append(f"{whole // size}{name}")
            whole %= size
    rest = round(whole + seconds - int(seconds), 2)
    parts.append(f"{rest:g}s" if rest == int(rest) else f"{rest:.2f}".rstrip("0") + "s")
    return sign + " ".join(parts)


def unit(n: int, most: str = UNITS[-1]) -> str:
    """The largest unit that n has one of, most at most."""
    k = 0
    while UNITS[k] != most and n >= 1 << 10 * (k + 1):
        k += 1
    return UNITS[k]


def bytes_in(n: int, name: str) -> str:
    return number(n / (1 << 10 * UNITS.index(name)))


def bytes_(n: int, most: str = UNITS[-1]) -> str:
    """In the largest unit that n has one of, most at most."""
    return f"{bytes_in(n, unit(n, most))} {unit(n, most)}"


def percent(part: int, whole: int) -> str:
    """Two digits; never 100 unless all is done."""
    if whole == 0 or part == whole:
        return "100"
    share = min(100 * part / whole, 99.99) if part < whole else 100 * part / whole
    return number(share)


def version(text: str) -> tuple[int, ...]:
    """For comparison."""
    return tuple(int(p) for p in text.split("-")[0].split("."))
