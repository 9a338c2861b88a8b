"""Scalar column functions: dates, names, paths, sizes and anchors. All stay inside the JVM.

Nulls give null unless a function says otherwise. Python's Unicode classes are written out
(``\\p{L}\\p{N}``), since Java's ``\\w`` and ``\\s`` know ASCII alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date formats in the order in which they are tried, and how each is written.
DATE_FORMATS = (
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-MM-dd"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy-MM-dd"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$", "yyyy-MM-dd"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$", "yyyy-MM-dd"),
    ("yyyy-M", r"^\d{4}-\d{1,2}$", "yyyy-MM"),
    ("yyyy/M", r"^\d{4}/\d{1,2}$", "yyyy-MM"),
    ("yyyy", r"^\d{4}$", "yyyy"),
)


def normalise_date(value: Column) -> Column:
    """A date string as yyyy-MM-dd, yyyy-MM or yyyy; what fits no format comes back stripped, null as ''."""
    text = F.trim(F.coalesce(value, F.lit("")))
    tried = [
        F.when(text.rlike(pattern) & ~text.rlike(r"(^|\D)0000(\D|$)"), F.date_format(F.try_to_timestamp(text, F.lit(form)), written))
        for form, pattern, written in DATE_FORMATS
    ]
    return F.coalesce(*tried, text)


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """As much of a date as its parts give: no year counts as 1900, an impossible day is left out."""
    y = F.when(F.coalesce(year, F.lit(0)) == 0, F.lit(1900)).otherwise(year)
    m, d = F.coalesce(month, F.lit(0)), F.coalesce(day, F.lit(0))
    to_month = F.format_string("%04d-%02d", y, m)
    whole = F.concat(to_month, F.format_string("-%02d", d))
    return F.when(m == 0, F.format_string("%04d", y)).when(F.expr("true") & (d > 0) & F.try_to_timestamp(whole, F.lit("yyyy-MM-dd")).isNotNull(), whole).otherwise(to_month)


def first_tag(tags: Column, names: list[str]) -> Column:
    """The first value of the first tag that has one; '' if none has."""
    return F.coalesce(*[F.nullif(F.get(F.try_element_at(tags, F.lit(n)), F.lit(0)), F.lit("")) for n in names], F.lit(""))


def track_number(value: Column) -> Column:
    return F.split_part(value, F.lit("/"), F.lit(1))


def fill_template(template: str, fields: dict[str, Column], order: list[str]) -> Column:
    """Replaces {field} one field after the other in the fixed order; inserted text is read again."""
    out = F.lit(template)
    for name in order:
        if name in fields:
            out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(fields[name], F.lit("")))
    return out


def safe_name(value: Column, otherwise: Column) -> Column:
    """Letters, numbers, blanks and ``-_.`` of a name; ``otherwise`` where nothing is left."""
    kept = F.regexp_replace(F.coalesce(value, F.lit("")), r"[^\p{L}\p{N} ._-]", "")
    return F.coalesce(F.nullif(kept, F.lit("")), otherwise)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^./](\.[^./]*)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def human_size(size: Column) -> Column:
    """Bytes in the largest unit below 1024 of it, two decimals; null counts as zero."""
    size = F.coalesce(size, F.lit(0)).cast("double")
    out = F.format_string("%.2f PB", size / float(1024**5))
    for power, unit in reversed(list(enumerate(("Bytes", "KB", "MB", "GB", "TB")))):
        out = F.when(size < float(1024 ** (power + 1)), F.format_string(f"%.2f {unit}", size / float(1024**power))).otherwise(out)
    return out


def natural_key(value: Column) -> Column:
    """Sort key in which digit runs count as numbers: texts in lower case and numbers by turns."""
    parts = F.regexp_extract_all(F.concat(value, F.lit("\u0000")), F.lit(r"([^0-9\x00]*)([0-9]*)"), F.lit(0))
    return F.transform(
        F.filter(parts, lambda p: p != ""),
        lambda p: F.struct(
            F.lower(F.regexp_replace(p, r"[0-9]+$", "")).alias("text"),
            F.coalesce(F.try_to_number(F.lpad(F.regexp_extract(p, r"([0-9]+)$", 1), 38, "0"), F.lit("9" * 38)).cast("decimal(38,0)"), F.lit(-1).cast("decimal(38,0)")).alias("number"),
        ),
    )


def percent_decode(value: Column) -> Column:
    """Percent-decoding that leaves a plus alone and a malformed text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)


def path_parts(value: Column) -> Column:
    """Lower-case parts of a path, without empty ones and single dots."""
    return F.transform(F.filter(F.split(value, "/"), lambda p: ~p.isin("", ".", "\\")), lambda p: F.lower(p))


# Punctuation that an anchor keeps, and which of it stays unencoded.
ANCHOR_KEEPS = "()?!.,;\"'*&%$"
ANCHOR_SAFE = {"%3F": "?", "%21": "!", "%2C": ",", "%3B": ";", "%22": '"', "%27": "'", "%2A": "*", "%26": "&", "%24": "$", "%7E": "~"}


def encode_anchor(heading: Column) -> Column:
    out = F.regexp_replace(heading, r"[^\p{L}\p{N}_\s\x{A0}()?!.,;\"'*&%$-]", "")
    out = F.replace(F.url_encode(out), F.lit("+"), F.lit("%20"))
    for coded, plain in ANCHOR_SAFE.items():
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return F.replace(out, F.lit("%25"), F.lit("%"))


def collapse_blanks(value: Column) -> Column:
    return F.array_join(F.filter(F.split(value, r"(?U)\s+"), lambda x: x != ""), " ")


def short_digest(value: Column) -> Column:
    """The first four hexadecimal digits of the MD5, as names of downloaded images have them."""
    return F.substring(F.md5(value), 1, 4)


def url_slug(url: Column) -> Column:
    last = F.substring_index(F.regexp_replace(url, r"/+$", ""), "/", -1)
    return F.regexp_replace(F.split_part(last, F.lit("."), F.lit(1)), r"[^A-Za-z0-9]", "_")


def html_title(html: Column) -> Column:
    """The title of a page as a safe file name; '' without one."""
    raw = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return collapse_blanks(F.regexp_replace(raw, r"[^\p{L}\p{N}_\s.\x{A0}-]", ""))


def book_file_name(title: Column) -> Column:
    return F.replace(F.regexp_replace(title, r"[()/\\]", ""), F.lit(" "), F.lit("_"))


def story_file_name(title: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(title, r"[\\/*?:\"<>|]", "")), F.lit("")), F.lit("output"))


def chunk_name(index: Column, stem_: Column) -> Column:
    return F.concat(F.format_string("chunk_%04d_", index), stem_, F.lit(".md"))


def relative_to(path: Column, base: Column) -> Column:
    """The path below a base folder by string prefix; other paths as they are."""
    prefix = F.concat(F.regexp_replace(base, r"/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)


def relative_path(path: Column, base: Column) -> Column:
    """The way from a base folder to a path, with ``..`` for each folder to leave; both absolute and without ``..``."""
    parts = lambda c: F.filter(F.split(c, "/"), lambda x: ~x.isin("", "."))
    p, b = parts(path), parts(base)
    same = F.filter(F.arrays_zip(p.alias("p"), b.alias("b")), lambda z: F.lit(True))
    parted = F.array_position(F.transform(same, lambda z: F.coalesce(z["p"] != z["b"], F.lit(True))), True)
    common = F.when(parted == 0, F.size(b)).otherwise(parted.cast("int") - 1)
    way = F.concat(F.array_repeat(F.lit(".."), F.size(b) - common), F.slice(p, common + 1, F.size(p)))
    return F.when(F.size(way) == 0, ".").otherwise(F.array_join(way, "/"))


def minutes_since(now_seconds: Column, then_seconds: Column) -> Column:
    return F.floor((now_seconds - then_seconds) / 60).cast("bigint")


def looks_truncated(reply: Column) -> Column:
    """Whether a JSON reply does not end with a closing brace (white space apart)."""
    return ~F.regexp_replace(reply, r"(?U)\s+$", "").endswith("}")


def outline_has_content(line: Column) -> Column:
    """Whether an outline line says anything besides its number and closing tags."""
    return F.regexp_replace(F.regexp_replace(line, r"^\d+:", ""), r"</[^>]+>", "").rlike("[a-zA-Z0-9]")


# The key prefixes of two platforms.
KEYS = {"darwin_to_linux": (("ctrl+", "meta+"), ("cmd+", "ctrl+")), "linux_to_darwin": (("ctrl+", "cmd+"), ("meta+", "ctrl+"))}


def swap_keys(value: Column, direction: str) -> Column:
    """Key names of one platform for the other's; the replacements run one after the other."""
    for read, written in KEYS[direction]:
        value = F.replace(value, F.lit(read), F.lit(written))
    return value
