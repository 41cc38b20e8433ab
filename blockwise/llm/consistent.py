"""Bringing visually identical text to one consistent form: DuckDB SQL inside Arrow partitions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwise.common import free_name

# Letters of other scripts that look like a Latin letter, and that letter.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    # Cherokee and Armenian
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮪ": "S", "Ꮲ": "P", "Ꮮ": "L", "Ꮯ": "C", "Ꮶ": "K", "Ᏼ": "B", "Ꮩ": "V",
    "օ": "o", "ս": "u", "հ": "h", "Օ": "O", "ո": "n", "ց": "g", "զ": "q", "յ": "j", "Ս": "U",
    "Ꭵ": "i", "Ꭹ": "y", "Ꮢ": "R", "Ꮤ": "W", "Ꮟ": "b",
    # Lisu
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    # Coptic
    "Ⲁ": "A", "Ⲃ": "B", "Ⲥ": "C", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲧ": "T", "Ⲭ": "X", "ⲟ": "o", "ⲥ": "c", "ⲣ": "p",
    # Latin letters made for phonetics
    "ɡ": "g", "ɑ": "a", "ı": "i",
}
#: Blocks whose compatibility forms look like the plain character: full-width forms, mathematical alphabets, letter-like
#: signs, Roman numerals, ligatures.
COMPAT_BLOCKS = ((0xFF01, 0xFF5E), (0x1D400, 0x1D7FF), (0x2102, 0x2138), (0x2160, 0x217F), (0xFB00, 0xFB06))
BLANKS = "               　"
HYPHENS = "‐‑"
#: Characters that take no room: format controls, soft hyphen, variation selectors, fillers, control characters.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2069}\x{206A}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E01EF}\x{0000}-\x{0008}\x{000E}-\x{001F}\x{007F}-\x{009F}]"
_RUNS = r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"


@lru_cache(1)
def compatibility() -> tuple[dict[str, str], dict[str, str]]:
    """(single, several): compatibility characters of the named blocks by the length of their plain form."""
    single, several = {}, {}
    for lo, hi in COMPAT_BLOCKS:
        for o in range(lo, hi + 1):
            ch = chr(o)
            plain = unicodedata.normalize("NFKC", ch)
            if plain != ch and all(unicodedata.category(c)[0] in "LNPS" for c in plain):
                (single if len(plain) == 1 else several)[ch] = plain
    single |= {c: " " for c in BLANKS} | {c: "-" for c in HYPHENS}
    return single, several


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@lru_cache(1)
def form_sql() -> str:
    """The DuckDB query of the consistent form x of every value v of the table ``batch`` (n, v)."""
    single, several = compatibility()
    v = f"regexp_replace(v, {_quote(INVISIBLE)}, '', 'g')"
    v = f"translate({v}, {_quote(''.join(single))}, {_quote(''.join(single.values()))})"
    for ch, plain in several.items():
        v = f"replace({v}, {_quote(ch)}, {_quote(plain)})"
    looks = f"translate(w, {_quote(''.join(LOOK_ALIKES))}, {_quote(''.join(LOOK_ALIKES.values()))})"
    # a run of letters is disguised if look-alikes turn it wholly Latin; a value without any Latin letter stays as it is
    word = f"CASE WHEN regexp_matches(w, '[^\\p{{Latin}}\\p{{M}}]') AND regexp_full_match({looks}, '[\\p{{Latin}}\\p{{M}}]+') THEN {looks} WHEN regexp_matches(w, '[ɡɑı]') THEN {looks} ELSE w END"
    runs = f"array_to_string(list_transform(regexp_extract_all(x, {_quote(_RUNS)}), lambda w: {word}), '')"
    # each step reads the rows it applies to only
    return f"""
WITH plain AS (SELECT n, nfc_normalize({v}) AS x FROM batch),
mixed AS (SELECT n, x, regexp_matches(x, '\\p{{Latin}}') AND regexp_matches(x, '[^\\x00-\\x{{024F}}]|[ıɡɑ]') AS m FROM plain)
SELECT n, x FROM mixed WHERE NOT m UNION ALL SELECT n, {runs} FROM mixed WHERE m"""


def consistent_form(df: DataFrame, columns: list[str], suffix: str = "_form") -> DataFrame:
    """The frame with a column ``<column><suffix>`` beside each text column, holding its consistent form.

    Full-width and other compatibility forms become plain characters, unusual blanks become a blank, invisible
    characters go, accents are composed, and words made Latin by replacing look-alike letters are made so, provided
    the value has a Latin letter. Words in another script, letter case and ordinary blanks stay. Null stays null and
    empty stays empty. Where a new name is taken, underscores are put before it. The work is one narrow map over Arrow
    batches: no shuffle, any text length.
    """
    names = []
    probe = df
    for c in columns:
        name = free_name(probe, c + suffix)
        names.append(name)
        probe = probe.withColumn(name, F.lit(None).cast("string"))
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.StringType()) for n in names)])

    def run(batches):
        import duckdb
        import pyarrow.compute as pc

        with duckdb.connect(config={"threads": 1, "memory_limit": "400MB"}) as con:
            for b in batches:
                made = []
                for c in columns:
                    # the distinct values of the batch that are not plain ASCII print
                    coded = b.column(b.schema.get_field_index(c)).cast(pa.string()).dictionary_encode()
                    values = coded.dictionary
                    odd = pc.invert(pc.match_substring_regex(values, "^[ -~]*$"))
                    places = pc.indices_nonzero(odd)
                    if len(places):
                        con.register("batch", pa.table({"n": places.cast(pa.int64()), "v": values.take(places)}))
                        out = con.sql(f"SELECT x FROM ({form_sql()}) ORDER BY n").to_arrow_table()
                        con.unregister("batch")
                        values = pc.replace_with_mask(values, odd, pa.array(out.column("x").to_pylist(), pa.string()))
                    made.append(values.take(coded.indices))
                yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *names])

    return df.mapInArrow(run, schema)


def disguised(entries: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field): the fields of each row whose value is not in its consistent form, each once.

    Null values and rows with a null key give nothing; repeated rows give one row.
    """
    formed = consistent_form(entries.where(F.col(key).isNotNull()).select(key, *columns), columns)
    both = F.array(*[F.when(F.col(c) != F.col(c + "_form"), F.lit(c)) for c in columns])
    return formed.select(key, F.explode(F.array_compact(both)).alias("field")).distinct()
