"""Column expressions of the model: ages, canonical bytes, identities, UTC text, CRC-32C."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

MAX = 9_223_372_036_854_775_807


def age(later: Column, earlier: Column) -> Column:
    """Nanoseconds from earlier to later, between 0 and the largest long."""
    return F.when(later <= earlier, F.lit(0)).otherwise(F.coalesce(F.try_subtract(later, earlier), F.lit(MAX))).cast("long")


def freshness(evaluated: Column, observed: Column, received: Column, recovered: Column, fresh: int, aging: int, allow: bool = False) -> Column:
    """0 fresh, 1 aging, 2 stale; limits belong to the better state, recovered evidence is aging at best."""
    old = age(evaluated, F.least(observed, received))
    verdict = F.when(old <= fresh, 0).when(old <= aging, 1).otherwise(2)
    return verdict if allow else F.when(recovered, F.greatest(verdict, F.lit(1))).otherwise(verdict)


def named(codes: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*map(F.lit, codes)), number.cast("int"))


def be64(number: Column) -> Column:
    """Eight big-endian bytes, two's complement."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 16, "0"))


def sized(text: Column) -> Column:
    """Bytes of a text after their number."""
    raw = F.encode(text, "UTF-8")
    return F.concat(be64(F.octet_length(raw)), raw)


def derived(prefix: str, text: Column) -> Column:
    """A 128-bit identity as 32 hexadecimal digits: SHA-256 of length-prefixed prefix and text, cut."""
    raw = F.concat(F.lit(bytes([len(prefix)]) + prefix.encode()), F.encode(text, "UTF-8"))
    return F.substring(F.sha2(raw, 256), 1, 32)


def typed(kind: str, name: Column) -> Column:
    """Text form of a derived identity, such as dev:<32 hex>."""
    prefix = {"fabric": "fab", "device": "dev", "source": "src", "incarnation": "inc"}.get(kind, kind)
    return F.concat(F.lit(prefix + ":"), derived(prefix, name))


def entity_id(kind: Column, text: Column) -> Column:
    return derived("entity", F.concat_ws("/", kind, text))


def format_utc(nanos: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.nnnnnnnnnZ in UTC, whatever the session's zone."""
    rest = F.pmod(nanos, F.lit(1_000_000_000))
    whole = F.floor((nanos - rest).cast("decimal(20,0)") / 1_000_000_000)
    days = F.floor(whole.cast("decimal(20,0)") / 86_400).cast("int")
    clock = F.pmod(whole.cast("long"), F.lit(86_400))
    part = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")
    return F.concat(day, F.lit("T"), part(F.floor(clock / 3600), 2), F.lit(":"), part(F.floor(F.pmod(clock, F.lit(3600)) / 60), 2), F.lit(":"), part(F.pmod(clock, F.lit(60)), 2), F.lit("."), part(rest, 9), F.lit("Z"))


def parse_utc(text: Column) -> Column:
    """Nanoseconds of such a text (T or space, up to nine digits of fraction) or of a plain integer; null if neither, or
    if they don't fit a long. A day of up to 31 counts on from the first of any month, and a second may be 60."""
    shape = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?Z$"
    part = lambda k: F.regexp_extract(text, shape, k)
    number = lambda k: part(k).try_cast("long")
    first = F.datediff(F.try_to_date(F.concat_ws("-", part(1), part(2), F.lit("01"))), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (first + number(3) - 1) * 86_400 + number(4) * 3600 + number(5) * 60 + number(6)
    nanos = F.try_add(F.try_multiply(seconds, F.lit(1_000_000_000).cast("long")), F.rpad(part(7), 9, "0").try_cast("long"))
    fits = number(3).between(1, 31) & (number(4) <= 23) & (number(5) <= 59) & (number(6) <= 60)
    return F.when(text.rlike(shape), F.when(fits, nanos)).otherwise(text.try_cast("long"))


@F.pandas_udf(StringType())
def real_bits(number: pd.Series) -> pd.Series:
    """The 16 hexadecimal digits of a double, which tell -0.0 from 0.0; Spark has no function for them."""
    bits = number.to_numpy("float64").view("uint64")
    return pd.Series([f"{b:016x}" for b in bits.tolist()]).where(number.notna(), None)


def canon(kind: Column, value: Column) -> Column:
    """Injective text of a scalar value: n, b:1, i:-5, u:7, r:<digits that tell the double from all others>,
    s:<bytes>:<text>, x:<hex>."""
    tag = F.concat(F.substring(kind, 1, 1), F.lit(":"), value)
    text = F.concat(F.lit("s:"), F.octet_length(value), F.lit(":"), value)
    scalar = F.when(kind == "null", "n").when(kind == "bool", F.concat(F.lit("b:"), F.when(value == "true", "1").otherwise("0")))
    return scalar.when(kind.isin("int", "uint", "real"), tag).when(kind == "text", text).when(kind == "blob", F.concat(F.lit("x:"), F.lower(value)))


def _counted(text: Column) -> Column:
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)


def canon_list(items: Column) -> Column:
    """Canonical text of a list from those of its items: l[<bytes>:<item>,...]."""
    return F.concat(F.lit("l["), F.array_join(F.transform(items, _counted), ","), F.lit("]"))


def canon_map(entries: Column) -> Column:
    """Canonical text of a map from its entries (key, value as canonical text), in order of keys; null if a key repeats."""
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    keys = F.transform(ordered, lambda e: e["key"])
    text = F.array_join(F.transform(ordered, lambda e: F.concat(_counted(e["key"]), F.lit("="), _counted(e["value"]))), ",")
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.concat(F.lit("m{"), text, F.lit("}")))


#: Levels of a nested value.
LEVELS = 8
ENVELOPE = "struct<k:string,v:string>"


def _scalar(kind: Column, value: Column) -> Column:
    """Canonical text of a scalar from its envelope's members; null where they don't go together."""
    digits, real = value.rlike("^[0-9]+$"), value.try_cast("double")
    whole = F.when(value.rlike("^-?[0-9]+$"), value.try_cast("long")).cast("string")
    natural = F.when(digits & (value.try_cast("decimal(38,0)") <= F.lit("18446744073709551615").cast("decimal(38,0)")), value.try_cast("decimal(38,0)")).cast("string")
    # a double's shortest text tells it from every other, and -0.0 from 0.0
    finite = F.when(value.rlike("^-?[0-9]") & (F.abs(real) < float("inf")), real).cast("string")
    blob = F.when(value.rlike("^([0-9a-fA-F]{2})*$"), value)
    made = F.when(kind == "null", F.lit("")).when(kind == "bool", F.when(value.isin("true", "false"), value)).when(kind == "int", whole)
    made = made.when(kind == "uint", natural).when(kind == "real", finite).when(kind == "text", value).when(kind == "blob", blob)
    return F.when(made.isNotNull(), canon(kind, made))


def canon_json(kind: Column, value: Column, levels: int = LEVELS) -> Column:
    """Canonical text of a value from its envelope {"k": kind, "v": ...}, where value is v as text: of lists (arrays of
    envelopes) and maps (arrays of {"k": key, "v": envelope}) too, down to so many levels. Null where kind and value
    don't go together, a map repeats a key, or the levels don't suffice."""
    scalar = _scalar(kind, value)
    if levels == 1:
        return scalar
    inner = lambda e: F.when(kind == "map", F.from_json(e["v"], ENVELOPE)).otherwise(e)
    items = F.transform(F.from_json(value, f"array<{ENVELOPE}>"), lambda e: F.struct(F.when(kind == "map", e["k"]).alias("key"), inner(e).alias("of")))
    texts = F.transform(items, lambda i: F.struct(i["key"].alias("key"), canon_json(i["of"]["k"], i["of"]["v"], levels - 1).alias("value")))
    odd = lambda t: F.exists(t, lambda i: i["value"].isNull() | ((kind == "map") & i["key"].isNull()))
    whole = lambda t: F.when(~odd(t), F.when(kind == "map", canon_map(t)).otherwise(canon_list(F.transform(t, lambda i: i["value"]))))
    # an array of one binds the texts, so that they are made once
    return F.when(kind.isin("list", "map"), F.get(F.transform(F.array(texts), whole), F.lit(0))).otherwise(scalar)


def members(*columns: Column) -> Column:
    """The members of a JSON object, without its braces, of columns by name; null ones are left out."""
    text = F.to_json(F.struct(*columns))
    return F.nullif(F.substring(text, F.lit(2), F.length(text) - 2), F.lit(""))


def envelope(kind: Column, value: Column) -> Column:
    """The envelope of a value as JSON text: numbers, arrays and truth values as they are, all else as strings."""
    bare = F.when(kind == "null", "null").when(kind.isin("bool", "real", "list", "map"), value)
    return F.concat(F.lit('{"k":"'), kind, F.lit('",'), F.coalesce(F.concat(F.lit('"v":'), bare), members(value.alias("v"))), F.lit("}"))


def identifier(text: Column, most: int = 64) -> Column:
    """Whether a text is a name: of a-z, 0-9 and ._-, not empty, within so many bytes."""
    return F.coalesce(text.rlike("^[a-z0-9._-]+\\z") & (F.octet_length(text) <= most), F.lit(False))


def authority_name(text: Column) -> Column:
    """Whether a text may name an authority: a name that has capitals, @ and : as well."""
    return F.coalesce(text.rlike("^[A-Za-z0-9._@:-]+\\z") & (F.octet_length(text) <= 64), F.lit(False))


def number_of(codes: tuple[str, ...], name: Column) -> Column:
    """The number of a name among codes; null if it is none of them."""
    place = F.array_position(F.array(*map(F.lit, codes)), name).cast("int")
    return F.when(place > 0, place - 1)


def escaped(text: Column) -> Column:
    """A text in quotes, with backslashes before quotes and backslashes, and control characters as \\n, \\r, \\t or \\x and
    two digits."""
    marks = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    for c, shown in (marks | {chr(n): f"\\x{n:02x}" for n in (*range(32), 127) if chr(n) not in marks}).items():
        text = F.replace(text, F.lit(c), F.lit(shown))
    return F.concat(F.lit('"'), text, F.lit('"'))


def saturating_sum(numbers: Column, limit: int = MAX) -> Column:
    """Sum of a column of longs that are not negative, at most limit."""
    return F.least(F.coalesce(F.sum(numbers.cast("decimal(38,0)")), F.lit(0)), F.lit(limit).cast("decimal(38,0)")).cast("long")


def port(device: Column, index: Column) -> Column:
    """port:<device>/<index>, with the device's text form."""
    return F.concat(F.lit("port:"), device, F.lit("/"), index.cast("string"))


def port_parts(text: Column) -> Column:
    """device and idx of a port's text (the prefix may be left out), null where it is none or idx has over 32 bits."""
    shape = r"^(?:port:)?(.+)/([0-9]+)$"
    index = F.regexp_extract(text, shape, 2).try_cast("decimal(38,0)")
    fine = text.rlike(shape) & (index <= 4_294_967_295)
    return F.when(fine, F.struct(F.regexp_extract(text, shape, 1).alias("device"), index.cast("long").alias("idx")))


def link(one: Column, other: Column) -> Column:
    """link:<port>|<port> of two ports' texts, the smaller by device and number first; null where they are equal."""
    a, b = port_parts(one), port_parts(other)
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(a != b, F.concat(F.lit("link:"), port(low["device"], low["idx"]), F.lit("|"), port(high["device"], high["idx"])))


def path(hops: Column) -> Column:
    """path:<32 hex> of an array of links' texts, in their order."""
    hop = lambda t: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(t) % 256), 2, "0")), F.encode(t, "UTF-8"))
    raw = F.aggregate(hops, F.concat(F.lit(b"\x04path"), be64(F.size(hops))), lambda s, t: F.concat(s, hop(t)))
    return F.concat(F.lit("path:"), F.substring(F.sha2(raw, 256), 1, 32))


@lru_cache(1)
def _crc_table() -> np.ndarray:
    n = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        n = np.where(n & 1, n >> 1 ^ np.uint32(0x82F63B78), n >> 1)
    return n


@F.pandas_udf(LongType())
def crc32c(raw: pd.Series) -> pd.Series:
    """CRC-32C (Castagnoli), which Spark lacks: all rows of a batch at once, byte by byte; rows in order of length, so
    that those that have ended are left out."""
    table, known = _crc_table(), raw.notna().to_numpy()
    texts = [bytes(x) if x is not None else b"" for x in raw]
    size = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-size, kind="stable")
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    left = np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), "right")
    crc = np.full(len(texts), 0xFFFFFFFF, np.uint32)
    for k, n in enumerate(left.tolist()):
        at = order[:n]
        c = crc[at]
        crc[at] = table[(c ^ data[start[at] + k]) & 255] ^ c >> 8
    return pd.Series((crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64), dtype="Int64").where(known)
