"""One consistent form for texts that look the same.

Texts are mapped to a skeleton by two built-in expressions (characters one to one, ligatures one to
many) and grouped under Spark's accent-sensitive, case-sensitive Unicode collation, which equates
joined with separate accents. Of each class one member is chosen, and joined back to the others
where there are others. Everything runs in the JVM; what is grouped are the different texts, so a text
repeated a million times counts once.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.stable import if_small, settle

# Letters of Cyrillic, Greek, Armenian, Cherokee and other blocks with the shape of a Latin letter.
SAME_SHAPE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ү": "y",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I", "Ү": "Y",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ρ": "p", "α": "a", "ι": "i", "υ": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "յ": "j", "Օ": "O", "Ս": "U", "Տ": "S",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "ɡ": "g", "ɑ": "a",
}
# Characters outside category Cf that show nothing.
SHOW_NOTHING = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"


#: Code points looked through: the basic plane, letters and symbols above it, tags and variation selectors.
_CODES = (*range(0xA0, 0xD800), *range(0xF900, 0xFFFE), *range(0x10000, 0x20000), *range(0xE0000, 0xE0200))


@cache
def character_map(more: tuple[tuple[str, str], ...] = ()) -> tuple[str, str, str, tuple[tuple[str, str], ...]]:
    """(characters, their replacements, characters to delete, ligatures with their letters), by rule over all planes.

    Wide, narrow and typeface forms become ordinary ones, every kind of space becomes a space, format
    characters and variation selectors go, ligatures, digraphs and Roman numerals become their letters, and
    same-shape letters Latin ones, alone and under accents. `more` adds pairs to SAME_SHAPE.
    """
    same = SAME_SHAPE | dict(more)
    from_, to, gone, ligatures = [], [], list(SHOW_NOTHING), []
    for code in _CODES:
        ch = chr(code)
        category = unicodedata.category(ch)
        if ch in SHOW_NOTHING or category == "Cn":
            continue
        if category == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code < 0xE01F0:
            gone.append(ch)
            continue
        tag = unicodedata.decomposition(ch).partition(" ")[0]
        plain = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", ch)) if tag in ("<wide>", "<narrow>", "<font>") else ch
        name = unicodedata.name(ch, "") if tag == "<compat>" else ""
        if category == "Zs" or plain == " ":
            plain = " "
        elif "LIGATURE" in name or "ROMAN NUMERAL" in name or category in ("Lu", "Ll", "Lt") and tag == "<compat>" and unicodedata.normalize("NFKD", ch)[1:2].isalpha():
            plain = unicodedata.normalize("NFKC", ch)
        if not plain.isascii():
            base, *marks = unicodedata.normalize("NFD", plain)
            if base in same:
                plain = unicodedata.normalize("NFC", same[base] + "".join(marks))
        if plain != ch and len(plain) == 1:
            from_.append(ch)
            to.append(plain)
        elif plain != ch:
            ligatures.append((ch, plain))
    return "".join(from_), "".join(to), "".join(gone), tuple(ligatures)


def skeleton(text: Column, more: tuple[tuple[str, str], ...] = ()) -> Column:
    """`text` with look-alike characters mapped; accents are left as they are written."""
    from_, to, gone, ligatures = character_map(more)
    several = F.rlike(text, F.lit("[" + "".join(a for a, _ in ligatures) + "]"))
    pairs = F.create_map(*(F.lit(x) for pair in ligatures for x in pair))
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(pairs, c), c)), "")
    return F.translate(F.when(several, spelled).otherwise(text), from_ + gone, to)


def canonical_texts(df: DataFrame, text: str, within: str) -> DataFrame:
    """(`within`, `text`, `canonical`, `n_texts`) for each different pair of non-null `within` and `text`.

    `canonical` is the same for all texts of one `within` that look the same: the member that the
    mapping leaves unchanged, else the shortest, then the first by code points. `n_texts` is the number of
    different texts in the class. Case and accents keep texts apart; a text of nothing visible falls
    into one class with the empty text. Repeated rows change nothing, an empty table gives no rows.
    """
    values = df.where(F.col(within).isNotNull() & F.col(text).isNotNull()).select(F.col(within).alias("__g"), F.col(text).alias("__t")).distinct().withColumn("__s", skeleton(F.col("__t")))
    rank = F.struct((F.col("__s") != F.col("__t")).alias("changed"), F.char_length("__t").alias("length"), F.col("__t").alias("text"))
    keyed = values.withColumn("__k", F.collate("__s", "UNICODE"))
    classes = keyed.groupBy("__g", "__k").agg(F.min(rank)["text"].alias("canonical"), F.count(F.lit(1)).alias("n_texts"))
    alone = classes.where("n_texts = 1").select(F.col("__g").alias(within), F.col("canonical").alias(text), "canonical", F.lit(1).cast("bigint").alias("n_texts"))
    shared = if_small(settle(classes.where("n_texts > 1")))
    members = keyed.join(shared, ["__g", "__k"]).select(F.col("__g").alias(within), F.col("__t").alias(text), "canonical", "n_texts")
    return alone.unionByName(members)


def look_alike_pairs(df: DataFrame, key: str, text: str, within: str) -> DataFrame:
    """(`wordid_a`, `wordid_b`), a < b: different non-null ids whose texts look the same but differ in characters.

    The different texts of a class are paired with each other first, and ids joined to either side
    after, so that the work follows the number of pairs and rows of equal text never meet. As that
    number may grow faster than the rows, `canonical_texts` is the form to use at scale. Repeated rows give a pair once.
    """
    several = settle(canonical_texts(df, text, within).where("n_texts > 1").select(F.col(within).alias("__g"), F.col(text).alias("__t"), "canonical"))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__id"), F.col(within).alias("__g"), F.col(text).alias("__t"))
    ids = settle(rows.join(if_small(several.select("__g", "__t")), ["__g", "__t"]).distinct())
    one, other = several.select("__g", "canonical", F.col("__t").alias("__ta")), several.select("__g", "canonical", F.col("__t").alias("__tb"))
    texts = one.join(other, ["__g", "canonical"]).where("__ta < __tb").select("__g", "__ta", "__tb")
    first = texts.join(ids.select("__g", F.col("__t").alias("__ta"), F.col("__id").alias("__a")), ["__g", "__ta"]).select("__g", "__tb", "__a")
    both = first.join(ids.select("__g", F.col("__t").alias("__tb"), F.col("__id").alias("__b")), ["__g", "__tb"]).where("__a <> __b")
    return both.select(F.least("__a", "__b").alias("wordid_a"), F.greatest("__a", "__b").alias("wordid_b")).distinct()
