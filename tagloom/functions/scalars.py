"""Column functions on tag values. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.plans.dims import GENRES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(text: Column | str) -> Column:
    """Without white space of any kind at either end; the built-in trim takes spaces only."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def ascii_lower(text: Column | str) -> Column:
    """A-Z folded and nothing else; lower() changes other letters, some to two code points."""
    return F.translate(_col(text), _UPPER, _LOWER)


def ascii_upper(text: Column | str) -> Column:
    return F.translate(_col(text), _LOWER, _UPPER)


def _number(text: Column) -> Column:
    """Digits without leading zeros, at least one; null for anything else."""
    return F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+(?=[0-9])", ""))


def track_disc(raw: Column | str) -> Column:
    """struct(number, total) of 'N/M' or 'N'; a part that isn't a number is null."""
    text = trim(raw)
    parts = F.split(text, "/", 2)
    return F.struct(_number(trim(F.element_at(parts, 1))).alias("number"), F.when(F.size(parts) > 1, _number(trim(F.try_element_at(parts, F.lit(2))))).alias("total"))


def combine_track_disc(number: Column | str, total: Column | str) -> Column:
    n, t = _col(number), _col(total)
    return F.when(t.isNotNull(), F.concat(F.coalesce(n, F.lit("0")), F.lit("/"), t)).otherwise(F.coalesce(n, F.lit("")))


def genre_name(number: Column | str) -> Column:
    """The name of a genre number, null outside of the table."""
    return F.try_element_at(F.array(*map(F.lit, GENRES)), _col(number).cast("int") + 1)


def genre_number(name: Column | str) -> Column:
    """The number of a genre name, whatever its ASCII case; null if there is none."""
    at = F.array_position(F.array(*[F.lit(ascii_fold(g)) for g in GENRES]), ascii_lower(name))
    return F.when(at > 0, (at - 1).cast("int"))


def ascii_fold(text: str) -> str:
    return text.translate(str.maketrans(_UPPER, _LOWER))


def _named(digits: Column) -> Column:
    """A number's genre, or the number itself without leading zeros."""
    number = digits.cast("int")
    return F.coalesce(genre_name(F.when(number < len(GENRES), number)), number.cast("string"))


#: Numbers of 16 bits, with a plus sign or not.
_U16 = r"\+?0*(?:6553[0-5]|655[0-2][0-9]|65[0-4][0-9]{2}|6[0-4][0-9]{3}|[1-5][0-9]{4}|[0-9]{1,4})"


def id3_genre(raw: Column | str) -> Column:
    """References like (17) by name, joined by '/'; text behind them stands for the last. A bare number by name; other text as it is."""
    text = trim(raw)
    groups = F.regexp_extract(text, rf"^((?:\({_U16}\))+)", 1)
    names = F.transform(F.regexp_extract_all(groups, F.lit(r"\(\+?([0-9]+)\)"), 1), _named)
    rest = trim(F.substr(text, F.length(groups) + 1))
    refined = F.when(rest == "", names).otherwise(F.concat(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), F.array(rest)))
    bare = F.coalesce(genre_name(F.when(text.rlike(rf"^{_U16}$"), F.try_to_number(F.regexp_replace(text, r"^\+", ""), F.lit("99999")).cast("int"))), text)
    return F.when(groups != "", F.array_join(refined, "/")).otherwise(bare)


def genre_list(raw: Column | str) -> Column:
    """The friendly view's reading, a list: references by name and then the text behind them, or else NUL-parted names."""
    text = _col(raw)
    groups = F.regexp_extract(text, r"^((?:\([^()]*\)\s*)+)", 1)
    marks = F.filter(F.regexp_extract_all(groups, F.lit(r"\(([^()]*)\)"), 1), lambda m: m != "")
    small = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"
    names = F.transform(marks, lambda m: F.when(m.rlike(small), _named(F.when(m.rlike(small), m))).otherwise(m))
    rest = trim(F.substr(text, F.length(groups) + 1))
    listed = F.concat(names, F.when(rest == "", F.array().cast("array<string>")).otherwise(F.array(rest)))
    plain = F.filter(F.transform(F.split(text, "\u0000"), trim), lambda x: x != "")
    found = F.when(text.startswith("("), listed).otherwise(plain)
    return F.when((F.size(found) == 0) & (text != ""), F.array(text)).otherwise(found)


def boolean(raw: Column | str) -> Column:
    """'1' for 1, true, yes; '0' for 0, false, no and nothing; else the trimmed text."""
    text = trim(raw)
    low = F.lower(text)
    return F.when(low.isin("1", "true", "yes"), "1").when(low.isin("0", "false", "no", ""), "0").otherwise(text)


def date(raw: Column | str) -> Column:
    return trim(raw)


_FLOAT = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def parse_float(raw: Column | str) -> Column:
    """A finite float of plain decimal text; null otherwise. The check keeps out suffixes that casts let through."""
    text = _col(raw)
    value = F.when(text.rlike(_FLOAT), text.try_cast("float"))
    return F.when((value < F.lit(float("inf")).cast("float")) & (value > F.lit(float("-inf")).cast("float")), value)


def parse_gain(raw: Column | str) -> Column:
    """Decibels as float: ' dB' or 'dB' may stand at the end."""
    return parse_float(trim(F.regexp_replace(trim(raw), " ?dB$", "")))


def parse_peak(raw: Column | str) -> Column:
    return parse_float(trim(raw))


def _fixed(value: Column, digits: int) -> Column:
    """Rounded half to even on the float's exact value, as decimal text is made from floats elsewhere; a decimal has room for its digits."""
    exact = value.cast("double").cast("decimal(38,18)")
    return F.bround(exact, digits).cast(f"decimal(38,{digits})").cast("string")


def format_gain(gain: Column | str) -> Column:
    """'+1.50 dB', two digits and a sign; null for what isn't finite."""
    g = _col(gain)
    text = _fixed(g, 2)
    return F.when(~F.isnan(g), F.concat(F.when(text.startswith("-"), text).when(g < 0, F.concat(F.lit("-"), text)).otherwise(F.concat(F.lit("+"), text)), F.lit(" dB")))


def format_peak(peak: Column | str) -> Column:
    p = _col(peak)
    return F.when(~F.isnan(p), _fixed(p, 6))


def adjustment_factor(gain: Column | str) -> Column:
    """10 ** (gain / 20), as float."""
    return F.pow(F.lit(10.0), _col(gain).cast("double") / 20).cast("float")


def timestamp(raw: Column | str) -> Column:
    """struct(text, year, month, day, hour, minute, second) of a partial date; parts out of range end it."""
    text = trim(raw)
    pattern = r"^([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2})(?:[T ]([0-9]{2})(?::([0-9]{2})(?::([0-9]{2}))?)?)?)?)?"
    parts, good = [], F.lit(True)
    for k, (name, lo, hi) in enumerate((("year", 0, 9999), ("month", 1, 12), ("day", 1, 31), ("hour", 0, 23), ("minute", 0, 59), ("second", 0, 59)), 1):
        n = F.regexp_extract(text, pattern, k).try_cast("int")
        good = good & F.coalesce(n.between(lo, hi), F.lit(False))
        parts.append(F.when(good, n).alias(name))
    return F.struct(text.alias("text"), *parts)


def intround(value: Column | str) -> Column:
    """Half to even; what isn't finite is 0."""
    v = _col(value).cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(v.isNull(), None).when(bad, F.lit(0)).otherwise(F.bround(F.least(F.greatest(v, F.lit(-9.2e18)), F.lit(9.2e18)), 0)).cast("bigint")


def synchsafe_decode(number: Column | str) -> Column:
    """The 28-bit number in the low seven bits of four bytes."""
    n = _col(number).cast("bigint")
    return sum(((F.shiftright(n, 8 * i).bitwiseAND(0x7F)) * (1 << 7 * i) for i in range(1, 4)), n.bitwiseAND(0x7F))


def synchsafe_encode(number: Column | str) -> Column:
    n = _col(number).cast("bigint")
    return sum(((F.shiftright(n, 7 * i).bitwiseAND(0x7F)) * (1 << 8 * i) for i in range(1, 4)), n.bitwiseAND(0x7F))


def is_frame_id(key: Column | str) -> Column:
    return _col(key).rlike("^[A-Z][A-Z0-9]{3}$")


def glob_to_regex(glob: str) -> str:
    """The regular expression of a shell pattern: * ? [..] [!..] and backslash escapes."""
    out, i = "^", 0
    quote = lambda c: "\\" + c if not c.isalnum() and c.isascii() and c != " " else c
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "\\" and i < len(glob):
            out += quote(glob[i])
            i += 1
        elif c == "[" and (end := glob.find("]", i + 1 + (glob[i : i + 1] == "!"))) > 0:
            body = glob[i:end]
            i = end + 1
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]"
        else:
            out += quote(c)
    return "(?s)" + out + "$"


def fnmatch(text: Column | str, glob: str) -> Column:
    return _col(text).rlike(glob_to_regex(glob))


def latin1(data: Column | str) -> Column:
    """Text of Latin-1 bytes."""
    return F.decode(_col(data), "iso-8859-1")


def decode_text(data: Column | str) -> Column:
    """Text of bytes by their byte order mark, UTF-8 without one."""
    d = _col(data)
    head = F.hex(F.substr(d, F.lit(1), F.lit(4)))
    return (
        F.when(head.startswith("EFBBBF"), F.decode(F.substr(d, F.lit(4)), "utf-8"))
        .when(head.isin("FFFE0000", "0000FEFF"), F.decode(d, "utf-32"))  # which reads the mark itself
        .when(head.startswith("FFFE"), F.decode(F.substr(d, F.lit(3)), "utf-16le"))
        .when(head.startswith("FEFF"), F.decode(F.substr(d, F.lit(3)), "utf-16be"))
        .otherwise(F.decode(d, "utf-8"))
    )


def padding(size: Column | str, content: Column | str) -> Column:
    """Bytes of padding to keep: the present size if it is from 0 to 10 KiB and 1 % of the content, else 1 KiB and 0.1 %."""
    s, c = _col(size).cast("bigint"), _col(content).cast("bigint")
    return F.when(s.between(0, F.lit(10 * 1024) + F.floor(c / 100)), s).otherwise(F.lit(1024) + F.floor(c / 1000))


def bit_padded(data: Column | str, bits: int = 7, big: bool = True) -> Column:
    """The number that is in the low bits of each of up to eight bytes."""
    d = _col(data)
    byte = lambda i: F.conv(F.hex(F.substr(d, i, F.lit(1))), 16, 10).cast("bigint").bitwiseAND((1 << bits) - 1)
    at = F.when(F.octet_length(d) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.octet_length(d)))
    return F.aggregate(at if big else F.reverse(at), F.lit(0).cast("bigint"), lambda a, i: F.shiftleft(a, bits) + byte(i))


def upgrade_frame_id(key: Column | str) -> Column:
    """The four-letter id of a three-letter frame id of version 2.2; other ids as they are, unknown three-letter ones null."""
    from tagloom.sources.parsers.id3 import UPGRADE

    k = _col(key)
    table = F.create_map(*[F.lit(x) for kv in UPGRADE.items() for x in kv])
    return F.when(F.length(k) == 3, F.try_element_at(table, k)).otherwise(k)


# Frame ids that version 2.2 also has, with its ids.
DOWNGRADE = {"TIT2": "TT2", "TPE1": "TP1", "TALB": "TAL", "TYER": "TYE", "TDRC": "TYE", "TCON": "TCO", "TRCK": "TRK", "COMM": "COM", "APIC": "PIC", "TEXT": "TXT", "TXXX": "TXX"}


def downgrade_frame_id(key: Column | str) -> Column:
    """The three-letter id of a four-letter frame id; null where version 2.2 has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in DOWNGRADE.items() for x in kv]), _col(key))


def over_limit(data: Column | str, most: int) -> Column:
    """Whether bytes break a cap; nothing never does."""
    return F.coalesce(F.octet_length(_col(data)) > most, F.lit(False))


def from_glob(glob: Column | str) -> Column:
    """glob_to_regex() of a column of patterns with * and ? only; every other character stands for itself."""
    quoted = F.regexp_replace(_col(glob), r"([^A-Za-z0-9 _*?])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", "."), F.lit("$"))
