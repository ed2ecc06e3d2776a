"""Paths, file names, durations and formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loupe.functions.keys import _c

# The extensions of supported formats and of images that are not supported.
FORMATS = {".jpg": "Jpeg", ".jpeg": "Jpeg", ".png": "Png", ".heic": "Heic", ".heif": "Heic"}
UNSUPPORTED_IMAGES = (".gif", ".bmp", ".tiff", ".tif", ".webp", ".raw", ".cr2", ".cr3", ".nef", ".arw", ".dng", ".orf")
#: Folder of set-aside duplicates; nothing below it is scanned.
ASIDE = "PotentialDuplicates"
#: Characters that file names may not hold (those of the strictest common file system).
FORBIDDEN = "".join(map(chr, range(32))) + '<>:"/\\|?*'


def extension(path: Column | str) -> Column:
    """Lower-case extension with its dot, or an empty text."""
    return F.lower(F.regexp_extract(F.substring_index(_c(path), "/", -1), r"(\.[^./\\]+)$", 1))


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/\\]*)$", 1)


def folder(path: Column | str) -> Column:
    """Everything before the last slash of either kind; empty if there is none."""
    return F.regexp_extract(_c(path), r"^(.*)[/\\][^/\\]*$", 1)


def stem(path: Column | str) -> Column:
    """File name without its extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def default_base_name(folders: Column | str) -> Column:
    """``<name> Slideshow`` after the one folder of an array, ``My Slideshow`` for several, none or one without a name."""
    path = F.when(F.size(_c(folders)) == 1, F.element_at(_c(folders), 1))
    cut = F.regexp_replace(path, r"[/\\]+$", "")
    name = F.when(cut.rlike("^([A-Za-z]:)?$"), path).otherwise(file_name(cut))  # a root is its own name
    return F.when(F.trim(name) != "", F.concat(name, F.lit(" Slideshow"))).otherwise("My Slideshow")


def supported_format(path: Column | str) -> Column:
    """Jpeg, Png or Heic by extension, else null."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    for name in ("Jpeg", "Png", "Heic"):
        out = F.when(ext.isin([e for e, f in FORMATS.items() if f == name]), F.lit(name)).otherwise(out)
    return out


def image_not_supported(path: Column | str) -> Column:
    return extension(path).isin(*UNSUPPORTED_IMAGES)


def set_aside(path: Column | str) -> Column:
    """Whether a folder above the file (not the file itself) is the set-aside folder."""
    parts = F.split(_c(path), r"[/\\]")
    maybe = F.upper(_c(path)).contains(ASIDE.upper())  # spares most paths the split
    return maybe & F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.upper(p) == ASIDE.upper())


def duration_text(seconds: Column | str) -> Column:
    """Hh Mm Ss, Mm Ss or Ss of whole seconds, rounded towards zero."""
    s = _c(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return (
        F.when(s >= 3600, F.format_string("%dh %dm %ds", h, m, r))
        .when(s >= 60, F.format_string("%dm %ds", m, r))
        .otherwise(F.format_string("%ds", r))
    )


def clock_text(seconds: Column | str) -> Column:
    """h:mm:ss"""
    s = _c(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def safe_file_name(name: Column | str) -> Column:
    """Without characters a file name may not hold, and trimmed."""
    return F.trim(F.translate(_c(name), FORBIDDEN, ""))


def spaced(name: Column | str) -> Column:
    """A blank before each capital that follows something else: HasVisualComponent."""
    return F.regexp_replace(_c(name), r"(?<=[^A-Z ])(?=[A-Z])", " ")


def percent(part: Column | str) -> Column:
    """Whole per cent, half to even."""
    return F.bround(_c(part) * 100).cast("int")


def snapped(value: Column | str, low: float, high: float, step: float) -> Column:
    """Clamped to [low, high], then rounded to a multiple of step, half to even."""
    return F.bround(F.least(F.greatest(_c(value), F.lit(low)), F.lit(high)) / step) * step


def hex16(hash_: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(_c(hash_))), 16, "0")


def from_hex16(text: Column | str) -> Column:
    """64-bit hash of 16 hexadecimal digits, as a two's complement number."""
    return F.conv(_c(text), 16, -10).cast("long")


def first_match(text: Column | str, rules: list[tuple[str, tuple[str, ...]]], other: str) -> Column:
    """Name of the first rule any of whose phrases the text contains, case aside."""
    low = F.lower(_c(text))
    out = F.lit(other)
    for name, phrases in reversed(rules):
        hit = F.lit(False)
        for p in phrases:
            hit = hit | low.contains(p.lower())
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def wrapped(text: Column | str, most: Column | int) -> Column:
    """Lines of a text: words are packed onto a line until the next would make it longer than ``most`` characters.

    Words are what lies between blanks; one that is longer than a line has a line of
    its own.  A text without words gives one line, the text itself.
    """
    t, most = _c(text), F.lit(most) if isinstance(most, int) else most
    words = F.filter(F.split(t, " "), lambda w: w != "")

    def add(state: Column, word: Column) -> Column:
        lines, line = state["lines"], state["line"]
        longer = F.concat(line, F.lit(" "), word)
        fits = F.length(longer) <= most
        return F.when(line.isNull(), F.struct(lines.alias("lines"), word.alias("line"))).otherwise(F.struct(
            F.when(fits, lines).otherwise(F.concat(lines, F.array(line))).alias("lines"), F.when(fits, longer).otherwise(word).alias("line")
        ))

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("line"))
    packed = F.aggregate(words, start, add, lambda s: F.concat(s["lines"], F.array(s["line"])))
    return F.when(F.size(words) > 0, packed).otherwise(F.array(t))


# Greatest and least size of a title in points, and the step between.
TITLE_SIZE, LEAST_SIZE, SIZE_STEP = 72, 16, 2


def fitted(text: Column | str, width: float, height: float, *, em: float = 0.5, leading: float = 1.2) -> Column:
    """STRUCT(size, lines): the greatest size at which the wrapped text fits into the box.

    em: width of a character and leading: height of a line, as parts of the size.
    At the least size the text may run over.
    """
    def at(size: Column) -> Column:
        most = F.floor(F.lit(width) / (size * em)).cast("int")
        lines = wrapped(text, most)
        longest = F.aggregate(lines, F.lit(0), lambda n, line: F.greatest(n, F.length(line)))
        return F.struct(size.alias("size"), lines.alias("lines"), ((longest <= most) & (F.size(lines) * size * leading <= height)).alias("fits"))

    sizes = F.transform(F.sequence(F.lit(TITLE_SIZE), F.lit(LEAST_SIZE), F.lit(-SIZE_STEP)), at)
    # arrays are searched from the greatest size on; the least comes last and is taken anyway
    found = F.element_at(F.filter(sizes, lambda s: s["fits"] | (s["size"] == LEAST_SIZE)), 1)
    return F.struct(found["size"].alias("size"), found["lines"].alias("lines"))
