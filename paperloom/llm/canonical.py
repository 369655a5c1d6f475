"""One form for text that looks the same in print (problem 5).

The work is embedded SQL: each Arrow batch of a Spark task is handed to an in-process DuckDB connection,
which drops invisible characters, translates wide forms, blanks, hyphens and look-alike letters, opens
joined letters and composes accents.  Spark partitions the rows; DuckDB never sees more than one batch.

What a reader can see stays: raised and lowered digits, fractions, en and em dashes, tabs, line breaks,
missing accents, upper and lower case.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from hashlib import md5

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

# --- fixed values: letters of other alphabets that print like a Latin letter -------------------------
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ё": "Ë", "Ї": "Ï",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ё": "ë", "ї": "ï",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϳ": "j",
    # Armenian, and a Latin letter with a second code
    "օ": "o", "ɡ": "g",
}
HYPHENS = "‐‑﹣⁃"
# --- end of fixed values ------------------------------------------------------------------------------

_KEPT_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<small>", "<vertical>")


@lru_cache(maxsize=1)
def character_rules() -> tuple[dict[str, str], dict[str, str], str]:
    """(one-to-one mappings, joined letters, invisible characters), made by rule from the Unicode database.

    Wide, narrow, positional and no-break forms fold to their base letter, blanks of any width to a space,
    Latin and Armenian ligatures to their letters.  Superscripts, fractions and circled forms are visible
    and have no entry.
    """
    single, joined, invisible = dict(LOOK_ALIKES), {}, []
    single |= dict.fromkeys(HYPHENS, "-")
    for code in (*range(0x80, 0x3400), *range(0xF900, 0x10000), *range(0xE0000, 0xE0200)):
        char = chr(code)
        kind, parts = unicodedata.category(char), unicodedata.decomposition(char).split()
        if kind == "Zs":
            single[char] = " "
        elif kind == "Cf" and not 0x600 <= code <= 0x605 and code not in (0x6DD, 0x70F) or 0xFE00 <= code <= 0xFE0F or code in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0):
            invisible.append(char)
        elif parts and (parts[0] in _KEPT_TAGS or parts[0] == "<compat>" and (0xFB00 <= code <= 0xFB4F or code in (0x0132, 0x0133, 0x0587) or 0x01C4 <= code <= 0x01CC or 0x01F1 <= code <= 0x01F3 or 0x2F00 <= code <= 0x2FDF)):
            to = "".join(chr(int(p, 16)) for p in parts[1:])
            to = "".join("-" if c in HYPHENS else " " if unicodedata.category(c) == "Zs" else c for c in to)
            (single if len(to) == 1 else joined)[char] = to
    return single, joined, "".join(invisible)


def quoted(text: str) -> str:
    """SQL literal of a text."""
    return "'" + text.replace("'", "''") + "'"


def _class(chars: str) -> str:
    """Regular-expression class of characters, neighbours written as ranges."""
    out, codes = "", sorted(map(ord, chars))
    first = last = codes[0]
    for code in [*codes[1:], 0x7FFFFFFF]:
        if code == last + 1:
            last = code
            continue
        out += f"\\x{{{first:X}}}" + (f"-\\x{{{last:X}}}" if last > first else "")
        first = last = code
    return f"[{out}]"


@lru_cache(maxsize=8)
def canonical_sql(column: str) -> str:
    """DuckDB expression that gives the one form of a text column.

    Texts without any character of the rules or combining marks, the great majority, are passed through
    after one regular-expression test.
    """
    single, joined, invisible = character_rules()
    marks = "".join(chr(c) for c in range(0x300, 0x1100) if unicodedata.combining(chr(c))) + "".join(chr(c) for c in range(0x1161, 0x1200))
    decomposing = "".join(c for c in map(chr, (*range(0x340, 0x400), *range(0x1F00, 0x2200), *range(0x2300, 0x2B00), *range(0xF900, 0xFB00))) if unicodedata.normalize("NFC", c) != c)
    touched = _class("".join({*single, *joined, *invisible, *marks, *decomposing}))
    text = f"regexp_replace({column}, {quoted(_class(invisible))}, '', 'g')"
    text = f"translate({text}, {quoted(''.join(single))}, {quoted(''.join(single.values()))})"
    for char, to in joined.items():
        if "ﬀ" <= char <= "ﬆ" or char in "ĳĲǆǅǄǉǈǇǌǋǊǳǲǱև":
            text = f"replace({text}, {quoted(char)}, {quoted(to)})"
    rest = "".join(c for c in joined if not ("ﬀ" <= c <= "ﬆ" or c in "ĳĲǆǅǄǉǈǇǌǋǊǳǲǱև"))
    compat = f"list_aggregate(list_transform(regexp_extract_all({text}, {quoted('(?s)' + _class(rest) + '|[^' + _class(rest)[1:] + '+')}), lambda piece: coalesce(map_extract_value({_sql_map({c: joined[c] for c in rest})}, piece), piece)), 'string_agg', '')"
    text = f"CASE WHEN regexp_matches({column}, {quoted(_class(rest))}) THEN {compat} ELSE {text} END"
    return f"CASE WHEN regexp_matches({column}, {quoted(touched)}) THEN nfc_normalize({text}) ELSE {column} END"


def _sql_map(pairs: dict[str, str]) -> str:
    return f"MAP([{', '.join(map(quoted, pairs))}], [{', '.join(map(quoted, pairs.values()))}])"


class Canonicalizer:
    """A DuckDB connection of one task, kept for all its batches."""

    def __init__(self) -> None:
        import duckdb

        self.connection = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        self.sql = f"SELECT {canonical_sql('text')} AS text FROM batch"

    def __call__(self, texts: pa.Array) -> pa.Array:
        """The texts in their one form; nulls stay null, order is kept."""
        self.connection.register("batch", pa.table({"text": texts}))
        out = self.connection.sql(self.sql).to_arrow_table().column("text")
        self.connection.unregister("batch")
        return pa.concat_arrays([c.cast(pa.large_string()) for c in out.chunks] or [pa.array([], pa.large_string())])


def canonicalize(df: DataFrame, column: str = "text", to: str = "canonical") -> DataFrame:
    """Adds column ``to`` with the one form of ``column``.

    Null texts stay null, empty texts stay empty, rows are never dropped or merged; a column named ``to``
    that exists already is replaced.
    """
    kept = [c for c in df.columns if c != to]
    source = df.select(*kept)
    schema = T.StructType([*source.schema.fields, T.StructField(to, T.StringType())])

    def run(batches):
        one_form = Canonicalizer()
        for batch in batches:
            if batch.num_rows:
                out = one_form(batch.column(kept.index(column))).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, out], [*kept, to])

    return source.mapInArrow(run, schema)


def text_keys(df: DataFrame, key: str = "chunk_id", column: str = "text") -> DataFrame:
    """(key, form, stored): 128-bit digests of the one form and of the stored form of each text.

    Rows with a null key or text are left out: nothing can be compared with them.
    """

    def digest(values: pa.Array) -> pa.Array:
        return pa.array([md5(v.as_buffer(), usedforsecurity=False).digest() for v in values], pa.binary())

    def run(batches):
        one_form = Canonicalizer()
        for batch in batches:
            if batch.num_rows:
                stored = batch.column(1).cast(pa.large_string())
                form = one_form(stored)
                changed = pc.not_equal(form, stored)
                first = digest(stored)
                other = digest(form.filter(changed))
                both = pc.replace_with_mask(first, changed, other)
                yield pa.RecordBatch.from_arrays([batch.column(0), both, first], [key, "form", "stored"])

    rows = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("string"), F.col(column))
    return rows.mapInArrow(run, f"`{key}` string, form binary, stored binary")


#: Exact copies of a stored text take part in all pairs up to this number; of more, the first speaks for them.
EXPANDED = 200
#: Records of one form that one task pairs with as many others.
PAIRED = 2000


def look_alike_pairs(df: DataFrame, key: str = "chunk_id", column: str = "text", expanded: int = EXPANDED) -> DataFrame:
    """(key_a, key_b): records whose texts differ as stored and look the same in print; the smaller key first.

    Only forms that were stored in at least two ways reach the self-join, so its work is that of its result; a form
    of very many records goes block against block.  Repeated rows count once; null keys and null texts take part in
    no pair.  Every two different stored texts of a form are paired.  Where more than ``expanded`` records hold one
    text exactly as stored, the first of them speaks for its copies (``form_classes`` gives each record its copies).
    """
    rows = written(text_keys(df, key, column).distinct(), "text-keys")
    several = rows.groupBy("form").agg(F.min("stored").alias("low"), F.max("stored").alias("high")).where("low < high").select("form")
    kept = written(rows.join(several, "form", "left_semi"), "look-alikes")
    sizes = kept.groupBy("form", "stored").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("head"))
    kept = kept.join(sizes, ["form", "stored"]).where((F.col("n") <= expanded) | (F.col(key) == F.col("head"))).select("form", "stored", key)
    blocks = kept.groupBy("form").agg(F.ceil(F.count(F.lit(1)) / PAIRED).cast("int").alias("blocks"))
    kept = kept.join(blocks, "form")
    a, b = (kept.select("form", F.col(key).alias(f"{key}_{x}"), F.col("stored").alias(f"stored_{x}"), "blocks") for x in "ab")
    a = a.withColumn("block", F.pmod(F.xxhash64(f"{key}_a"), F.col("blocks").cast("bigint")).cast("int")).drop("blocks")
    b = b.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return a.join(b, ["form", "block"]).where(f"`{key}_a` < `{key}_b` AND stored_a <> stored_b").select(f"{key}_a", f"{key}_b").distinct()


def form_classes(df: DataFrame, key: str = "chunk_id", column: str = "text") -> DataFrame:
    """(key, form_id, stored_id, stored_forms, records, copies): one row per record and text, with the digests of its
    one form and of its stored text, in how many ways that form is stored, in how many records, and how many records
    hold the very same text.  Repeated rows count once."""
    rows = written(text_keys(df, key, column).distinct(), "text-keys")
    stored = rows.groupBy("form", "stored").agg(F.countDistinct(key).alias("copies"))
    sizes = rows.groupBy("form").agg(F.countDistinct("stored").alias("stored_forms"), F.countDistinct(key).alias("records"))
    out = rows.join(stored.join(sizes, "form"), ["form", "stored"])
    return out.select(key, F.lower(F.hex("form")).alias("form_id"), F.lower(F.hex("stored")).alias("stored_id"), "stored_forms", "records", "copies")
