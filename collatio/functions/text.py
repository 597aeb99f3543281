"""Normalisation and tokens of transcriptions: native expressions for Latin text, exact functions for any."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Markup of uncertain readings (the reading stays), and of gaps (nothing stays but a space).
UNCLEAR = r"(?i)<\s*/?\s*unclear\s*>"
GAP = r"(?i)<\s*(?:gap|illegible)\s*/?\s*>"
BOM = "\ufeff"
SPACES = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: Letters below U+0250 whose case folding isn't their lower case, and the final sigma.
FOLDS = (("\u00df", "ss"), ("\u00b5", "\u03bc"), ("\u017f", "s"), ("\u0149", "\u02bcn"), ("\u01f0", "j\u030c"), ("\u03c2", "\u03c3"))


TOKENS = ArrayType(StructType([StructField("text", StringType()), StructField("raw_start", IntegerType()), StructField("raw_end", IntegerType())]))


def prepared(text: Column) -> Column:
    """Without byte order marks, with line feeds only, tags as spaces."""
    x = F.regexp_replace(F.replace(text, F.lit(BOM), F.lit("")), "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(x, UNCLEAR, " "), GAP, " ")


def normalized(text: Column) -> Column:
    """normalize() with built-in functions; equal to it on composed Latin text."""
    x = prepared(text)
    for a, b in FOLDS:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.lower(x)
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[\p{P}\p{S}]", " "), SPACES, " "))


def words(text: Column) -> Column:
    """Words of a normalised text; none of an empty one."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def compose(text: str) -> str:
    """The first steps, which keep offsets: marks of byte order out, line feeds only, composed; tags become as many spaces."""
    x = unicodedata.normalize("NFC", re.sub("\r\n?", "\n", text.replace(BOM, "")))
    for pattern in (UNCLEAR, GAP):
        x = re.sub(pattern, lambda m: " " * len(m[0]), x)
    return x


class _Spaced(dict):
    """A table for str.translate: characters between tokens become a space each, others stay; filled as characters are met."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        self[code] = out = 32 if c.isspace() or unicodedata.category(c)[0] in "PS" else code
        return out


_SPACED = _Spaced()
_TOKEN = re.compile("[^ ]+")


def spaced(text: str) -> str:
    """A composed text, as long as before, with a space for each character that is no part of a token."""
    return text.translate(_SPACED)


def tokenize(text: str) -> list[tuple[str, int, int]]:
    """(folded token, start, end) over a composed text; folding may lengthen a token, the offsets stay those of the text."""
    return [(m[0].casefold(), m.start(), m.end()) for m in _TOKEN.finditer(spaced(text))]


def normalize(text: str) -> str:
    return " ".join(_TOKEN.findall(spaced(compose(text)).casefold()))


#: Bytes of texts that a function has at work at once: what it makes of them is handed on before the next come.
PIECE = 1_000_000


def pieces(texts: pa.Array, most: int | None = None) -> Iterator[slice]:
    """Rows of a batch by so many bytes of text, one row at least."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (most or PIECE), "right")))
        yield slice(at, end)
        at = end


@F.arrow_udf(StringType())
def normalize_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for rows in pieces(texts):
            yield pa.array([None if x is None else normalize(x) for x in texts[rows].to_pylist()], pa.string())


def token_arrays(texts: list[str | None]) -> pa.Array:
    """tokenize() of composed texts as one array: edges of tokens by position, words by the spaces between them."""
    words, edges, sizes = [], [np.zeros(0, np.int64)], [0]
    for x in texts:
        s = spaced(compose(x or ""))
        words += s.casefold().split()
        edges.append(np.flatnonzero(np.diff(np.frombuffer(s.encode("utf-32-le"), np.uint32) != 32, prepend=False, append=False)))
        sizes.append(len(words))
    edge = np.concatenate(edges).astype(np.int32)
    parts = [pa.array(words, pa.string()), pa.array(edge[::2]), pa.array(edge[1::2])]
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(parts, names=TOKENS.elementType.names))


@F.arrow_udf(TOKENS)
def tokenize_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for rows in pieces(texts):
            yield token_arrays(texts[rows].to_pylist())


#: Stands between tokens: no rule of normalisation changes it.
BETWEEN = "\x01"


def misplaced(text: Column, tokens: Column) -> Column:
    """Number of tokens that differ from the normalised text between their offsets. Slices are cut from four bytes a character, not counted out from the beginning for each, and a text's are normalised as one."""
    cut = lambda u, t: F.decode(F.substring(u, t["raw_start"] * 4 + 1, (t["raw_end"] - t["raw_start"]) * 4), "UTF-32")
    found = lambda u: F.transform(tokens, lambda t: cut(u, t))
    bound = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  x is computed once, not for each token
    joined = lambda s: F.split(F.regexp_replace(normalized(F.array_join(s, BETWEEN)), f" ?{BETWEEN} ?", BETWEEN), BETWEEN)
    each = lambda s: F.when(F.contains(text, F.lit(BETWEEN)), F.transform(s, normalized)).otherwise(joined(s))
    return F.size(F.filter(F.zip_with(bound(F.encode(text, "UTF-32"), lambda u: each(found(u))), tokens, lambda a, t: F.when(t.isNull(), False).otherwise(~a.eqNullSafe(t["text"]))), lambda wrong: wrong))


def natural_key(name: Column) -> Column:
    """A string that sorts as the name does with runs of digits read as numbers and letters in lower case: a number is led by its count of digits."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 4, "0"), digits(p))).otherwise(p)), "")


def folder_name(model: Column) -> Column:
    return F.regexp_replace(F.replace(model, F.lit(":"), F.lit("_")), "[^A-Za-z0-9._-]+", "_")


def experiment_name(number: Column) -> Column:
    return F.concat(F.lit("experiment_"), F.format_string("%03d", number))


def relative(path: Column, root: str) -> Column:
    return F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substr(path, F.lit(len(root.rstrip("/")) + 2))).otherwise(path)


def seconds(nanoseconds: Column) -> Column:
    return F.round(nanoseconds.try_cast("double") / 1e9, 6)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
