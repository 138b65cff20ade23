"""One form for texts that look the same: look-alike mapping, accent-sensitive collation, a canonical member per class.

1. SQL's translate maps full-width forms, look-alike Cyrillic and Greek letters and blanks to plain characters and drops
   invisible ones; ligatures are replaced by their letters. The mapped texts keep their accents.
2. Only texts that share a rough key with a different text go on: the key is the hash of the mapped text without any accent.
3. The mapped values are grouped under the UNICODE collation, for which a composed accent equals the combining one, while case,
   accents and punctuation count. The least of the texts is the class's canonical member and is joined back.
4. The collation also holds a few characters for equal that look different (digits of other scripts), so a class is divided by
   the exact canonical form of its members.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.filters import maybe_in
from tessera.session import cut, spread

LEAST = 200

# Letters of other scripts and the Latin letters they look like, by Unicode's table of confusable characters (which holds I
# and l for one; the letter of the same case is taken here).
_CYRILLIC = ("ЅІЈАВЕКМНОРСТУХЬагеорсухѕіјѡѴѵҮүһҽӀӏԁԌԚԛԜԝꙇ", "SIJABEKMHOPCTYXbareopcyxsijwVvYyheIldGQqWwi")
_GREEK = ("ͿΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγινορσυϒϜϱϲϳϹϺ", "JABEZHIKMNOPTYXayivopouYFpcjCM")


def _tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Mapped characters, expanded ligatures, and the base letters of accented ones; all from Unicode's own data."""
    alike = dict(zip(*_CYRILLIC)) | dict(zip(*_GREEK))
    mapped, ligatures, bases = dict(alike), {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        name = unicodedata.name(c, "")
        if kind == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            mapped[c] = ""
        elif kind == "Zs":
            mapped[c] = " "
        elif 0xFF01 <= code <= 0xFF5E:
            mapped[c] = chr(code - 0xFEE0)
        elif "LIGATURE" in name and (d := unicodedata.decomposition(c)).startswith("<compat>"):
            ligatures[c] = unicodedata.normalize("NFKC", c)
        elif kind[0] == "L" and not 0xAC00 <= code <= 0xD7A3:
            whole = unicodedata.normalize("NFD", c)
            if len(whole) > 1 and all(unicodedata.combining(m) for m in whole[1:]):
                if whole[0] in alike:
                    mapped[c] = unicodedata.normalize("NFC", alike[whole[0]] + whole[1:])
                bases[c] = alike.get(whole[0], whole[0])
        if unicodedata.combining(c):
            bases[c] = ""
    return mapped, ligatures, bases


_MAPPED, _LIGATURES, _BASES = _tables()
_BY_CODE = str.maketrans(_MAPPED | _LIGATURES)


def canonical(text: str) -> str:
    """The exact canonical form, in Python."""
    return text if text.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_BY_CODE).translate(_BY_CODE))


#: Matches a text that has any character beyond those of which none is mapped or accented: ASCII, and plain signs and punctuation.
_UNUSUAL = r"[^\x00-\x7F\u00A1-\u00AC\u00AE-\u00BF\u2010-\u2027\u2030-\u205E\u20A0-\u20CF\u2122]"


def _translate(c: Column, table: dict[str, str]) -> Column:
    # one for one, then the dropped ones. Look-alikes with several marks have no single Latin letter and stay as they are.
    kept = [k for k, v in table.items() if len(v) == 1] + [k for k, v in table.items() if not v]
    return F.translate(c, "".join(kept), "".join(table[k] for k in kept))


def _expanded(c: Column) -> Column:
    """Ligatures as their letters."""
    own = list(_LIGATURES.items())
    letters = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), own, c)
    return F.when(c.rlike("[" + "".join(k for k, _ in own) + "]"), letters).otherwise(c)


def mapped(c: Column) -> Column:
    """The text with look-alikes, full-width forms, blanks, ligatures and invisible characters made plain. Accents stay."""
    return F.when(c.rlike(_UNUSUAL), _translate(_expanded(c), _MAPPED)).otherwise(c)


def rough(c: Column) -> Column:
    """Hash of the mapped text without accents: equal for all texts that look the same, and for few others."""
    own = {k: v for k, v in _BASES.items() if len(v) < 2}
    # one pass for both tables: what the first maps to has its accents removed at once
    both = own | {k: own.get(v, v) for k, v in _MAPPED.items() if len(v) < 2}
    return F.xxhash64(F.when(c.rlike(_UNUSUAL), _translate(_expanded(c), both)).otherwise(c))


def look_alike_classes(df: DataFrame, keys: list[str], text: str = "text", least: int = LEAST, within: str | None = None) -> DataFrame:
    """(keys, class_id, form, raw): the rows whose text looks the same as some other, different text of the table.

    class_id: hash of the class's canonical text; form: the canonical member, the least of its texts as mapped; raw: hash of the text as
    delivered. Equal texts are combined before the comparison and all come back with their class. Null texts and those of
    fewer than ``least`` code points as delivered take no part. Repeated rows count once. ``within``: one of the keys, such as the
    name of a table; only texts that are equal in it are compared.
    """
    part = [F.col(within)] if within else []
    rows = df.select(*keys, F.col(text).alias("__text")).filter(F.length("__text") >= least)
    rows = spread(rows)
    # one pass over the texts for their hashes, written once, so that the mapping isn't worked out again for each use
    hashed = cut(rows.select(*keys, F.xxhash64(*part, rough(F.col("__text"))).alias("__rough"), F.xxhash64(*part, "__text").alias("raw")).distinct())
    several = hashed.groupBy("__rough").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).filter("a <> b").select("__rough")
    wanted = cut(hashed.join(several, "__rough", "left_semi").select(*keys, "raw"))
    near = maybe_in(rows, F.xxhash64(*keys), wanted.select(F.xxhash64(*keys).alias("__key")), "__key").join(wanted, keys).dropDuplicates(keys)
    own = [F.max(within).alias("__part")] if within else [F.lit(0).alias("__part")]
    texts = near.groupBy("raw").agg(F.max("__text").alias("__text"), *own).withColumn("__value", F.collate(mapped(F.col("__text")), "UNICODE"))
    chosen = texts.groupBy("__part", "__value").agg(F.min(F.collate("__value", "UTF8_BINARY")).alias("form"), F.count("*").alias("n")).filter("n > 1").drop("n")
    back = texts.join(chosen, ["__part", "__value"]).select("raw", "__text", "form")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [canonical(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(forms, pa.string())], names=["raw", "form", "exact"])

    divided = back.mapInArrow(exact, "raw bigint, form string, exact string").select("raw", "form", F.sha2("exact", 256).alias("class_id"))
    return wanted.join(divided, "raw").select(*keys, "class_id", "form", "raw")


def canonical_texts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, form): every text in the one form in which texts that look the same are equal. A null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t if t is None else canonical(t) for t in b.column(1).to_pylist()], pa.string())], names=[key, "form"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, form string")
