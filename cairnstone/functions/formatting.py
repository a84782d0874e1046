"""Number and path formatting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_DASH = "—"


def _fixed(v: Column, digits: int) -> Column:
    """Rounds the exact binary value; exact ties go up."""
    v = F.when(v * 4 == F.floor(v * 4), v + 1e-9).otherwise(v)
    return F.call_function("format_number", v, F.lit("0." + "0" * digits if digits else "0"))


def _unit(v: Column, i: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))


def _finite(n: Column) -> Column:
    return ~(F.isnan(n) | F.abs(n).isin(float("inf")))


def _scaled(n: Column, base: float, names: list[str]) -> tuple[Column, Column]:
    i = F.floor(F.log(F.abs(n)) / F.log(F.lit(base)) + 1e-12)
    i = F.greatest(F.lit(0), F.least(i, F.lit(len(names) - 1)))
    return n / F.pow(F.lit(base), i), i


def bytes_(n: Column) -> Column:
    """Decimal units; no digits below 1 KB and from 100 on."""
    names = ["B", "KB", "MB", "GB", "TB", "PB", "EB"]
    v, i = _scaled(n, 1000.0, names)
    text = F.when((i == 0) | (v >= 100), _fixed(v, 0)).otherwise(_fixed(v, 1))
    return F.when(~_finite(n), _DASH).when(n == 0, "0 B").otherwise(F.concat(text, F.lit(" "), _unit(v, i, names)))


def bibytes(n: Column, digits: int = 0) -> Column:
    """Binary units."""
    names = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]
    v, i = _scaled(n, 1024.0, names)
    text = F.when((i == 0) | (v == F.floor(v)), _fixed(v, 0)).otherwise(_fixed(v, digits))
    return F.when(~_finite(n), _DASH).when(n == 0, "0 B").otherwise(F.concat(text, F.lit(" "), _unit(v, i, names)))


def rate(n: Column) -> Column:
    return F.when(n > 0, F.concat(bytes_(n), F.lit("/s"))).otherwise(_DASH)


def count(n: Column) -> Column:
    names = ["", "k", "M", "B", "T"]
    v, i = _scaled(n, 1000.0, names)
    text = F.when(v >= 100, _fixed(v, 0)).otherwise(_fixed(v, 1))
    return F.when(~_finite(n), _DASH).when(F.abs(n) < 1000, F.floor(n + 0.5).cast("string")).otherwise(F.concat(text, _unit(v, i, names)))


def pct(part: Column, whole: Column, digits: int = 0) -> Column:
    return F.when(F.coalesce(whole, F.lit(0)) == 0, "0%").otherwise(F.concat(_fixed(part / F.nullif(whole, F.lit(0)) * 100, digits), F.lit("%")))


def duration(s: Column) -> Column:
    """At most two units; rounds before it picks them."""
    r = F.floor(s + 0.5).cast("long")
    m, rest = F.floor(r / 60).cast("long"), r % 60
    minutes = F.when(rest > 0, F.format_string("%dm %ds", m, rest)).otherwise(F.format_string("%dm", m))
    return (
        F.when(~_finite(s) | (s < 0), _DASH)
        .when(s < 1, F.format_string("%dms", F.floor(s * 1000 + 0.5).cast("long")))
        .when(s < 10, F.concat(_fixed(s, 1), F.lit("s")))
        .when(r < 60, F.format_string("%ds", r))
        .when(m < 60, minutes)
        .otherwise(F.format_string("%dh %dm", F.floor(m / 60).cast("long"), m % 60))
    )


def ms(v: Column) -> Column:
    return F.when(~_finite(v), _DASH).when(v == 0, "0 ms").when(v < 10, F.concat(_fixed(v, 1), F.lit(" ms"))).otherwise(F.format_string("%d ms", F.floor(v + 0.5).cast("long")))


def ago(then_ms: Column, now_ms: Column) -> Column:
    s = (now_ms - then_ms) / 1000
    return (
        F.when(s < 45, "just now")
        .when(s < 3600, F.format_string("%dm ago", F.floor(s / 60 + 0.5).cast("long")))
        .when(s < 86400, F.format_string("%dh ago", F.floor(s / 3600 + 0.5).cast("long")))
        .otherwise(F.date_format(F.timestamp_millis(then_ms), "d MMM"))
    )


def clock(then_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(then_ms), "HH:mm:ss")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def parent_of(path: Column) -> Column:
    s = segments(path)
    return F.concat(F.lit("/"), F.array_join(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), "/"))


def join_path(base: Column, name: Column) -> Column:
    return F.when(base == "/", F.concat(F.lit("/"), name)).otherwise(F.concat(base, F.lit("/"), name))


def breadcrumbs(path: Column) -> Column:
    """Every prefix of a path, the root first."""
    s = segments(path)
    return F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(s, 1, i), "/")))


def file_href(path: Column) -> Column:
    parts = F.array_join(F.transform(segments(path), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")
    return F.when(parts == "", "/files").otherwise(F.concat(F.lit("/files/"), parts))


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def human(n: Column) -> Column:
    """Steps of 1024 with decimal names, as the command line prints sizes."""
    names = ["B", "KB", "MB", "GB", "TB", "PB"]
    v, i = _scaled(F.when(n == 0, F.lit(1.0)).otherwise(n.cast("double")), 1024.0, names)
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(F.concat(_fixed(v, 1), F.lit(" "), _unit(v, i, names)))


def parse_size(text: Column) -> Column:
    """Bytes of `128MiB`, `1 KB` or `7`; KB is KiB; null if it isn't a size."""
    t = F.upper(F.trim(text))
    number, unit = F.regexp_extract(t, r"^(\d+)\s*([KMGTP]?)(I?B)?$", 1), F.regexp_extract(t, r"^(\d+)\s*([KMGTP]?)(I?B)?$", 2)
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).when(unit == "P", 5).otherwise(0)
    return F.when(number == "", F.lit(None)).otherwise(number.cast("long") * F.pow(F.lit(1024.0), power).cast("long"))


def permissions(is_dir: Column, mode: Column) -> Column:
    bits = [F.when(mode.bitwiseAND(F.lit(1 << (8 - i))) != 0, "rwxrwxrwx"[i]).otherwise("-") for i in range(9)]
    return F.concat(F.when(is_dir, "d").otherwise("-"), *bits)


def block_name(id: Column) -> Column:
    return F.concat(F.lit("blk_"), F.lpad(id.cast("string"), 16, "0"))


def bar(fraction: Column, width: int) -> Column:
    """Exactly width cells, in eighths of a cell."""
    f = F.least(F.lit(1.0), F.greatest(F.lit(0.0), fraction))
    eighths = F.floor(f * width * 8 + 0.5).cast("int")
    full, rest = F.floor(eighths / 8).cast("int"), eighths % 8
    part = F.element_at(F.array(*[F.lit(c) for c in ["", "▏", "▎", "▍", "▌", "▋", "▊", "▉"]]), rest + 1)
    return F.rpad(F.concat(F.repeat(F.lit("█"), full), part), width, " ")


def sparkline(values: Column) -> Column:
    low, high = F.array_min(values), F.array_max(values)
    span = F.when(high - low > 0, high - low).otherwise(F.lit(1.0))
    levels = F.array(*[F.lit(c) for c in "▁▂▃▄▅▆▇█"])
    return F.array_join(F.transform(values, lambda v: F.element_at(levels, (F.floor((v - low) / span * 7 + 0.5) + 1).cast("int"))), "")


def policy_factor(policy: Column) -> Column:
    return (
        F.when(policy.startswith("replication-"), F.regexp_extract(policy, r"(\d+)$", 1).cast("double"))
        .when(policy == "lrc-6-2-2", F.lit(10 / 6))
        .when(policy == "rs-6-3", F.lit(9 / 6))
        .otherwise(F.lit(1.0))
    )
