"""Column functions on paths, codes, sizes and times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks of track types in output order; fixed values.
TYPE_RANK = {"video": 0, "audio": 1, "subtitles": 2, "buttons": 3, "chapters": 4, "attachment": 5}


def type_rank(kind: Column, ranks: dict[str, int] = TYPE_RANK) -> Column:
    """The rank of a type; unknown ones come last."""
    return reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), list(ranks.items())[1:], F.when(kind == next(iter(ranks)), ranks[next(iter(ranks))])).otherwise(len(ranks))


def parent_dir(path: Column) -> Column:
    """What stands before the last slash or backslash; empty where there is none."""
    return F.regexp_extract(path, r"(?s)^(.*)[/\\]", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/\\]*)$", 1)


def drive_key(path: Column) -> Column:
    """A drive letter with colon, else a share (``\\\\server\\share``, either slash before the share), upper-case; else ``default``."""
    letter, share = F.regexp_extract(path, r"^([A-Za-z]:)", 1), F.regexp_extract(path, r"^(\\\\[^\\/]+[\\/][^\\/]+)", 1)
    return F.coalesce(F.upper(F.nullif(letter, F.lit(""))), F.upper(F.nullif(share, F.lit(""))), F.lit("default"))


def shell_quoted(text: Column) -> Column:
    """Text for display: in double quotes, with those inside escaped, where it is empty or holds white space, quotes or backslashes."""
    return F.when((text == "") | text.rlike(r"""[\s"'\\]"""), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(text)


def display_language(*codes: Column) -> Column:
    """The first code that is neither null nor empty, else ``und``."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in codes], F.lit("und"))


def equivalent_codes(*codes: Column) -> Column:
    """Lower-case distinct codes; ``und`` alone where there is none."""
    found = F.array_distinct(F.filter(F.transform(F.array(*codes), F.lower), lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(found) == 0, F.array(F.lit("und"))).otherwise(found)


def trimmed(text: Column) -> Column:
    """Text without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+$", "")


def distinct_folded(items: Column) -> Column:
    """Items of which those that differ in case only are one, in the first one's spelling and place."""
    folded = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1)


def language_list(listed: Column) -> Column:
    """Codes of a comma-separated list, trimmed, lower-case, without empties; null (all match) where none is left."""
    found = F.filter(F.transform(F.split(listed, ","), lambda x: F.lower(trimmed(x))), lambda x: x != "")
    return F.when(F.size(found) > 0, found)


def clock_ns(ns: Column) -> Column:
    """Nanoseconds as HH:MM:SS.nnnnnnnnn, hours unbounded."""
    second = F.lit(1_000_000_000)
    whole = ((ns - F.pmod(ns, second)) / second).cast("long")
    return F.format_string("%02d:%02d:%02d.%09d", F.floor(whole / 3600).cast("long"), F.pmod(F.floor(whole / 60), F.lit(60)).cast("long"), F.pmod(whole, F.lit(60)), F.pmod(ns, second))


def clock_ms(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS; ``--:--:--`` for null and negative ones."""
    s = F.floor(ms / 1000)
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(s / 3600)
    shown = F.concat(F.when(hours < 10, part(hours)).otherwise(hours.cast("string")), F.lit(":"), part(F.pmod(F.floor(s / 60), F.lit(60))), F.lit(":"), part(F.pmod(s, F.lit(60))))
    return F.when(ms >= 0, shown).otherwise("--:--:--")


#: Units of sizes and bit rates: the base and the labels; fixed values.
LADDERS = {"K": (1024, "K"), "KM": (1024, "K M"), "KMG": (1024, "K M G"), "KMGT": (1024, "K M G T"), "KMi": (1000, "Ki Mi"), "KMiGi": (1000, "Ki Mi Gi"), "KMiGiTi": (1000, "Ki Mi Gi Ti")}


def in_units(n: Column, suffix: str, unit: str = "KMGT", decimals: int = 2) -> Column:
    """A whole number in the largest unit that it exceeds, rounded half up to ``decimals`` places without zeros at the end, with the unit and ``suffix``; bare below the
    first unit; empty for null and negative ones."""
    base, labels = LADDERS[unit]
    shown = F.concat(n.cast("string"), F.lit(suffix))
    scale = 10**decimals
    for k, label in enumerate(labels.split(), 1):
        parts = F.expr("0").cast("long") + F.floor((n.cast("decimal(38,0)") * (2 * scale) + base**k) / (2 * base**k)).cast("long")
        whole, rest = F.floor(parts / scale).cast("long").cast("string"), F.lpad(F.pmod(parts, F.lit(scale)).cast("string"), decimals, "0")
        rest = F.regexp_replace(rest, "0+$", "")
        text = F.concat(whole, F.when(F.length(rest) > 0, F.concat(F.lit("."), rest)).otherwise("")) if decimals else parts.cast("string")
        shown = F.when(n > base**k, F.concat(text, F.lit(label + suffix))).otherwise(shown)
    return F.when(n >= 0, shown).otherwise("")


def double_in_units(n: Column, suffix: str, unit: str = "KMGT", decimals: int = 2) -> Column:
    """The same of a double: the quotient is a double, whose exact binary value is rounded half up; below the first unit, and for one that is finite, it is shown as it is, whole numbers
    without a point. Empty for null, negative and infinite ones. The tier is chosen first and the number scaled once."""
    base, labels = LADDERS[unit]
    tiers = labels.split()
    label, divisor = F.lit(""), F.lit(1.0)
    for k, said in enumerate(tiers, 1):
        label, divisor = F.when(n > float(base**k), said).otherwise(label), F.when(n > float(base**k), float(base**k)).otherwise(divisor)
    q = n / divisor
    # above the first unit a quotient is over 1, so what follows its point is a whole number of 2**-52
    scale, whole = 10**decimals, F.floor(q)
    # up to three decimals this stays within 64 bits
    parts = F.shiftright(((q - whole) * F.lit(float(2**52))).cast("long") * (2 * scale) + 2**52, 53)
    whole = whole + F.when(parts == scale, 1).otherwise(0)
    rest = F.regexp_replace(F.lpad(F.pmod(parts, F.lit(scale)).cast("string"), decimals, "0"), "0+$", "") if decimals else F.lit("")
    scaled = F.concat(whole.cast("string"), F.when(F.length(rest) > 0, F.concat(F.lit("."), rest)).otherwise(""))
    bare = F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))
    shown = F.concat(F.when(label == "", bare).otherwise(scaled), label, F.lit(suffix))
    return F.when((n >= 0) & (n < float("inf")), shown).otherwise("")


def thousandths(x: Column) -> Column:
    """A positive number rounded to three places, shown without zeros at the end."""
    n = F.floor(x * 1000 + 0.5).cast("long")
    rest = F.regexp_replace(F.lpad(F.pmod(n, F.lit(1000)).cast("string"), 3, "0"), "0+$", "")
    return F.concat(F.floor(n / 1000).cast("long").cast("string"), F.when(F.length(rest) > 0, F.concat(F.lit("."), rest)).otherwise(""))


def frame_rate(duration_ns: Column) -> Column:
    """Frames per second from a frame's duration; null where there is none."""
    return F.when(duration_ns > 0, F.concat(thousandths(F.lit(1e9) / duration_ns), F.lit("fps")))


def sample_rate(hz: Column) -> Column:
    return F.when(hz > 0, F.concat(thousandths(hz / 1000), F.lit("kHz")))


#: Labels of channel layouts; fixed values.
LAYOUTS = {
    "mono": "mono", "stereo": "stereo", "layout21": "2.1", "layout30": "3.0", "layout31": "3.1", "layout40": "4.0", "layout41": "4.1", "layout50": "5.0", "layout51": "5.1", "layout61": "6.1", "layout71": "7.1",
    "layout714": "7.1.4",
}


def channel_label(layout: Column, channels: Column) -> Column:
    """The layout's label, else mono, stereo or the number of channels; null where neither is known."""
    known = F.create_map(*[F.lit(x) for kv in LAYOUTS.items() for x in kv])[layout]
    return F.coalesce(known, F.when(channels == 1, "mono").when(channels == 2, "stereo").otherwise(F.concat(channels.cast("string"), F.lit("ch"))))


def joined(*parts: Column) -> Column:
    """The parts that are neither null nor empty, with blanks between."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def attachment_subtype(name: Column, mime: Column) -> Column:
    """What follows the name's last dot, else the media type's slash, lower-case; else empty."""
    ext, sub = F.regexp_extract(name, r"(?s)\.([^.]+)$", 1), F.regexp_extract(mime, r"(?s)^[^/]*/(.+)$", 1)
    return F.lower(F.coalesce(F.nullif(ext, F.lit("")), F.nullif(sub, F.lit("")), F.lit("")))


def stat_number(tags: Column, name: str) -> Column:
    """The number in the first tag (struct of name and value) of that name, in whatever case; null where there is none or it is no number."""
    own = F.filter(tags, lambda t: F.upper(t["name"]) == name.upper())
    value = F.trim(F.get(own, 0)["value"])
    return F.when(value == "", 0.0).otherwise(F.when(value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), value.cast("double")))


def output_dir(own: Column, common: Column, path: Column) -> Column:
    """The file's own output folder, else the common one, else where the file lies."""
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(common, F.lit("")), parent_dir(path))


def stem(path: Column) -> Column:
    """A file name without its last extension; a leading dot belongs to the name."""
    name = file_name(path)
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1)).otherwise(name)


def overridden_path(override: Column, path: Column, is_folder: Column | None = None) -> Column:
    """An override that ends with a slash is a folder, which the input's name is put into; so is one that is known to be a folder (``is_folder``). Any other is the output itself."""
    ends = override.rlike(r"[/\\]$")
    inside = F.concat(override, F.when(ends, "").otherwise("/"), file_name(path))
    return F.when(ends | (F.lit(False) if is_folder is None else F.coalesce(is_folder, F.lit(False))), inside).otherwise(override)


def progress(line: Column) -> Column:
    """The whole number of a progress line of the merge tool; null for other lines."""
    found = F.regexp_extract(F.trim(line), r"^Progress:(?:Progress:)*\s*\+?(\d{1,9})%*$", 1)
    return F.nullif(found, F.lit("")).cast("int")


def newer(latest: Column, current: Column) -> Column:
    """Whether a dotted version is later: number by number, missing ones are 0 and parts that are no numbers don't count."""
    parts = lambda v: F.transform(F.filter(F.split(F.regexp_replace(v, "^v+", ""), r"\."), lambda x: x.rlike(r"^\+?\d+$")), lambda x: x.cast("long"))
    a, b = parts(latest), parts(current)
    n = F.greatest(F.size(a), F.size(b))
    fill = lambda x: F.concat(x, F.array_repeat(F.lit(0).cast("long"), n - F.size(x)))
    return fill(a) > fill(b)


def eta(elapsed: Column, percent: Column, status: Column | None = None) -> Column:
    """Time left by the progress so far; null unless it is between nothing and all and, where a status is given, that is ``merging``."""
    left = F.when((percent > 0) & (percent < 100), elapsed * (100 - percent) / percent)
    return left if status is None else F.when(status == "merging", left)
