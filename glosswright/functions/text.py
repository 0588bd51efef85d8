"""Caption and anchor text: Column functions. The character class that counts as text is a parameter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
#: Han characters: the basic block, and with extension A.
HAN = "一-鿿"
HAN_EXT = "一-鿿㐀-䶿"
LETTERS = "A-Za-z"
#: Variant characters and their usual forms.
VARIANTS = {
    "懐": "懷", "歳": "歲", "増": "增", "戦": "戰", "経": "經", "様": "樣", "変": "變",
    "辺": "邊", "売": "賣", "読": "讀", "聴": "聽", "桜": "櫻", "対": "對", "仏": "佛",
    "図": "圖", "国": "國", "広": "廣", "応": "應", "円": "圓", "栄": "榮", "険": "險",
}
ANNOTATIONS = ("上聯", "下聯", "橫批", "横批", "上联", "下联", "横聯", "對聯", "对联", "注")
MARKERS = ("上聯", "下聯", "橫批", "横批", "上联", "下联", "横聯")
NOISE = ("根據", "圖片", "錄入", "如下", "由右", "由左", "由上", "由下", "書法內容", "以下")
SIGNATURE, SIGNATURE_START = "落款", "【"
OPENING, CLOSING = "（(【「『〔[", "）)】」』〕]"
SKIP_PATTERNS = (
    "週[一二三四五六日末].{0,6}[課練]",
    "毎日一字",
    "每日一字",
    "老師.*作品|國畫.*詩意|買鴻鈞",
    "讀字時光",
)
LEAST_CHARS = 4


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once a row, also where ``then`` uses it inside a lambda."""
    return F.transform(F.array(value), then)[0]


def keep_chars(text: Column, kept: str = HAN_EXT) -> Column:
    """The characters of a class; null gives an empty string."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{kept}]+", "")


def unify_variants(text: Column, variants: dict[str, str] | None = None) -> Column:
    variants = VARIANTS if variants is None else variants
    return F.translate(text, "".join(variants), "".join(variants.values()))


def normalise(text: Column, simplify: dict[str, str] | None = None, variants: dict[str, str] | None = None) -> Column:
    """Variants unified, then traditional characters simplified by a table the caller has (one character to one)."""
    out = unify_variants(text, variants)
    return F.translate(out, "".join(simplify), "".join(simplify.values())) if simplify else out


def sorted_chars(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, ""), lambda c: c != "")), "")


def safe_id(post_id: Column) -> Column:
    return F.translate(post_id, ":=", "__")


def _class(characters: str) -> str:
    return "[" + "".join("\\" + c if c in "[]()" else c for c in characters) + "]"


def strip_annotations(text: Column, words: tuple[str, ...] = ANNOTATIONS) -> Column:
    """Removes bracketed annotations; opening and closing brackets need not match."""
    return F.regexp_replace(text, f"(?U){_class(OPENING)}\\s*(?:{'|'.join(words)})\\s*{_class(CLOSING)}", "")


def strip_markers(caption: Column, anchor: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    """Removes, one marker after the other, those that the caption has and the anchor lacks."""
    for m in markers:
        caption = F.when(~anchor.contains(m), F.replace(caption, F.lit(m), F.lit(""))).otherwise(caption)
    return caption


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def anchor_lines(text: Column, noise: tuple[str, ...] = NOISE, mark: str = SIGNATURE, start: str = SIGNATURE_START) -> Column:
    """Lines of a machine reading without blank lines, remarks and the signature."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != "")
    bad = lambda x: x.contains(mark) | x.startswith(start)
    for word in noise:
        bad = lambda x, rest=bad, w=word: rest(x) | x.contains(w)
    return F.filter(lines, lambda x: ~bad(x))


def skip_reason(caption: Column, kept: str = HAN_EXT, patterns: tuple[str, ...] = SKIP_PATTERNS, least: int = LEAST_CHARS) -> Column:
    """Why a caption is skipped: too few characters, or the first pattern found in it; else null."""
    n = F.length(keep_chars(caption, kept))
    return F.coalesce(
        F.when(n < least, F.concat(F.lit("too few characters ("), n.cast("string"), F.lit(")"))),
        *[F.when(caption.rlike(p), F.lit(f"pattern {i + 1}")) for i, p in enumerate(patterns)],
    )


def disposition(images: Column, reason: Column, counted: bool = True) -> Column:
    """``no_images`` goes silently, ``skipped`` is counted, the rest is ``kept``. Not ``counted``: either is ``dropped``, and both have been marked as seen before."""
    if not counted:
        return F.when((F.coalesce(F.size(images), F.lit(0)) <= 0) | reason.isNotNull(), "dropped").otherwise("kept")
    return F.when(F.coalesce(F.size(images), F.lit(0)) <= 0, "no_images").when(reason.isNotNull(), "skipped").otherwise("kept")


def membership(text: Column, caption: Column) -> Column:
    """The share of the text's characters that the caption has; null for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return let(caption, lambda own: F.try_divide(F.size(F.filter(chars, lambda c: F.contains(own, c))).cast("double"), F.size(chars).cast("double")))


def verify_label(clean: Column, caption: Column, kept: str = HAN_EXT, share: float = 0.75, least: int = LEAST_CHARS) -> Column:
    """Why a label fails against its caption, or null."""
    own = keep_chars(caption, kept)
    ratio = membership(normalise(clean, variants={}), own)
    return (
        F.when(F.coalesce(clean, F.lit("")) == "", "empty")
        .when(own == "", "caption has no text")
        .when(ratio < share, F.concat(F.lit("not in caption ("), F.bround(ratio * 100, 0).cast("int").cast("string"), F.lit("%)")))
        .when(F.length(clean) < least, F.concat(F.lit("too short ("), F.length(clean).cast("string"), F.lit(" chars)")))
    )


def reply_fields(reply: Column, kept: str = HAN_EXT) -> Column:
    """The fields of a structured model reply: ``has_calligraphy, clean_text, high_count``; what is missing is false, empty or 0, and a count beyond 32 bits is the largest of them."""
    digits = F.regexp_extract(F.coalesce(reply, F.lit("")), r"HIGH_COUNT:\s*0*(\d+)", 1)
    return F.struct(
        (F.upper(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?i)HAS_CALLIGRAPHY:\s*(YES|NO)", 1)) == "YES").alias("has_calligraphy"),
        keep_chars(F.regexp_extract(F.coalesce(reply, F.lit("")), r"CLEAN_TEXT:\s*(.+)", 1), kept).alias("clean_text"),
        F.when(F.length(digits) > 10, (1 << 31) - 1).otherwise(F.least(F.coalesce(digits.try_cast("long"), F.lit(0)), F.lit((1 << 31) - 1)).cast("int")).alias("high_count"),
    )


def iso_time(epoch: Column) -> Column:
    """Epoch seconds as ISO-8601 UTC (for a session in UTC); null where out of the years 1 to 9999."""
    ok = epoch.between(-62135596800, 253402300799)
    return F.when(ok, F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss+00:00"))


def stamp(time: Column | None = None) -> Column:
    """A time of the session's zone as text, by default now: the same for all rows of a query."""
    return F.date_format(F.current_timestamp() if time is None else time, "yyyy-MM-dd HH:mm:ss")


def folder_name(n: Column) -> Column:
    return F.when(n < 10000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string"))


def path_tail(path: Column) -> Column:
    """What follows the last slash; null without a slash."""
    return F.when(path.contains("/"), F.element_at(F.split(path, "/"), -1))


def has_label(label: Column) -> Column:
    return F.length(strip(F.coalesce(label, F.lit("")))) > 0


def coverage(clean: Column, caption: Column, kept: str = HAN_EXT) -> Column:
    return F.bround(F.coalesce(F.try_divide(F.length(clean).cast("double"), F.length(keep_chars(caption, kept)).cast("double")), F.lit(0.0)), 3)


def line_counts(text: Column, kept: str = HAN) -> Column:
    """Character counts of the lines that have any."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(keep_chars(x, kept))), lambda n: n > 0)


def prompt(template: str, caption: Column) -> Column:
    """A template with ``{cap}`` replaced by the caption."""
    return F.replace(F.lit(template), F.lit("{cap}"), F.coalesce(caption, F.lit("")))
