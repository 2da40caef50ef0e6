"""Text rules as column expressions. All are deterministic and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def normalize(t: Column) -> Column:
    """Every run of Unicode whitespace as one space, none at the ends."""
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def html_escape(t: Column) -> Column:
    """``&``, ``<`` and ``>`` only."""
    return F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def resolve_entity(name: Column) -> Column:
    """The five predefined XML entities; null for any other name."""
    pairs = [("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")]
    out = F.lit(None).cast("string")
    for n, c in pairs:
        out = F.when(name == n, F.lit(c)).otherwise(out)
    return out


def opens_with_marker(t: Column) -> Column:
    """A bullet and space, or a number of three digits at most or a letter, perhaps in ``(``, closed by ``.`` or ``)``, and space."""
    return F.regexp_replace(t, r"(?U)^\s+", "").rlike(r"^([•·▪◦‣–—*\-](?U:\s)|\(?([0-9]{1,3}|[A-Za-z])[.)](?U:\s))")


def opens_with_word(t: Column, pieces: Column) -> Column:
    """First character a letter or digit, and more than one character where other pieces follow."""
    s = F.trim(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(s.rlike(r"^[\p{L}\p{N}]"), F.lit(False)) & ~((pieces > 1) & (F.length(s) == 1))


def section_number(t: Column) -> Column:
    """Depth of a leading section number: parts of ``2.1.3``, 1 for a Roman numeral with a point; null without one."""
    head = F.regexp_extract(F.regexp_replace(t, r"(?U)^\s+", ""), r"(?U)^(\S+)\s", 1)
    digits = F.regexp_extract(head, r"^([0-9]+(?:\.[0-9]+)*)\.?$", 1)
    roman = head.rlike(r"^([IVXLCDM]+|[ivxlcdm]+)\.$")
    return F.when(roman, F.lit(1)).when(digits != "", F.least(F.size(F.split(digits, r"\.")), F.lit(255)))


def is_label_head(h: Column) -> Column:
    """A bullet, a number with points, or a letter or Roman numeral that ``.`` or ``)`` closes."""
    return h.rlike(r"^([•·▪◦‣–—*\-]|\(?[0-9]+(\.[0-9]+)*[.)]*|\(?([A-Za-z]|[IVXLC]+|[ivxlc]+)[.)]+)$")


def opens_with_label(t: Column) -> Column:
    head = F.regexp_extract(F.regexp_replace(t, r"(?U)^\s+", ""), r"(?U)^(\S+)\s", 1)
    return (head != "") & is_label_head(head)


#: lead, currency, digits with groups, decimals, unit, closer
NUMBER = r"(?s)^([(\-−–+]?)([$€£¥]?)([0-9]{1,18}|[0-9]{1,3}(?:,[0-9]{3}){1,5})(?:\.([0-9]{1,6}))?(?U:\s?)((?i:%|x|k|m|bn|b|pp)?)(\)?)$"


def number(t: Column) -> Column:
    """The value of a printed number as decimal(38,10); null where the whole text isn't one.

    ``(12)`` and a leading minus are negative; k, m, b and bn scale by 10**3, 10**6, 10**9.
    """
    part = lambda i: F.regexp_extract(t, NUMBER, i)
    value = F.concat(F.replace(part(3), F.lit(","), F.lit("")), F.when(part(4) != "", F.concat(F.lit("."), part(4))).otherwise(F.lit(""))).try_cast("decimal(28,6)")
    unit = F.lower(part(5))
    scale = F.when(unit == "k", F.lit(1000)).when(unit == "m", F.lit(1000000)).when(unit.isin("b", "bn"), F.lit(1000000000)).otherwise(F.lit(1))
    sign = F.when(part(1).isin("-", "−", "–") | (part(1) == "(") & (part(6) == ")"), F.lit(-1)).otherwise(F.lit(1))
    return F.when(t.rlike(NUMBER), (value * scale.cast("decimal(10,0)") * sign.cast("decimal(1,0)")).cast("decimal(38,6)"))


def is_year(t: Column) -> Column:
    return t.rlike("^(19|20)[0-9]{2}$")


def prose(t: Column) -> Column:
    """Starts in lower case and has thirty characters or more."""
    return t.rlike(r"^\p{Ll}") & (F.length(t) >= 30)


def ends_with_leaders(t: Column) -> Column:
    """Three leader dots or more at the end, spaces allowed between them."""
    return F.rtrim(t).rlike(r"([.\u2026] *){3,}$")


def weight_word(font: Column) -> Column:
    """What follows the last ``-`` or ``,`` of a font's name."""
    return F.regexp_extract(font, r"[-,]([^-,]*)$", 1)


def media_type_for(filter_name: Column) -> Column:
    """How an image's stream is packed, from its last filter."""
    return F.when(filter_name == "DCTDecode", F.lit("image/jpeg")).when(filter_name == "JPXDecode", F.lit("image/jp2")).otherwise(F.lit("application/octet-stream"))


def resolve_target(base: Column, target: Column) -> Column:
    """A relationship's part name: absolute, or from the folder of ``base``; ``.`` and empty steps drop, ``..`` over the root gives ''."""
    folder = F.regexp_replace(base, r"[^/]*$", "")
    path = F.when(target.startswith("/"), target).otherwise(F.concat(folder, target))
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("out"), F.lit(True).alias("ok"))

    def step(acc, s):
        up = s == ".."
        out = F.when(up, F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0)))).otherwise(F.concat(acc["out"], F.array(s)))
        return F.struct(out.alias("out"), (acc["ok"] & ~(up & (F.size(acc["out"]) == 0))).alias("ok"))

    return F.aggregate(steps, start, step, lambda a: F.when(a["ok"], F.array_join(a["out"], "/")).otherwise(F.lit("")))


def split_codes(b: Column, width: int) -> Column:
    """The big-endian codes of ``width`` bytes each in a binary; what is left over is not a code."""
    return F.transform(F.regexp_extract_all(F.hex(b), F.lit(f"(.{{{2 * width}}})"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("bigint"))


def json_string(t: Column) -> Column:
    """A canonical JSON string: short escapes where there are any, ``\\u00xx`` in lower case for other controls, the rest literally."""
    out = F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    for c in range(32):
        out = F.replace(out, F.lit(chr(c)), F.lit(short.get(c, f"\\u{c:04x}")))
    return F.concat(F.lit('"'), out, F.lit('"'))


def json_object(members: dict[str, Column]) -> Column:
    """A canonical object: members by name; strings have to be canonical values already."""
    parts = [F.concat(F.lit(f'"{k}":'), members[k]) for k in sorted(members)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
