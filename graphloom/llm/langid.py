"""Language identification by compression against per-language raw-content dictionaries.

``fit`` gathers, per language, a bounded sample of training text as a zstandard raw-content
dictionary. ``identify`` compresses every block of a text once with each dictionary: the language
whose dictionary gives the fewest bytes wins; a narrow margin between the best two is a rejection.

Defined results: a null text, or one without a letter, gives ``und`` with score 0 and is rejected;
equal sizes go to the smaller language name and are rejected; without a single learned language
every text is ``und``; an empty table gives an empty table with the same columns. Texts are read whole, however long.
Repeated rows are judged alike; extra columns pass through, but columns named like the results, in any case, are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import releasing, small_batches
from graphloom.llm.frequency import ROWS

#: Bytes of text compressed at once: small enough that the dictionary matters in each block.
BLOCK_BYTES = 2048
#: Bound of the fit: documents sampled per language, and bytes taken from each.
SAMPLE_DOCS, SAMPLE_BYTES = 256, 1024
#: Greedy matching of four bytes or more: word stems of any language are shorter than zstandard's usual matches.
PARAMS = zstandard.ZstdCompressionParameters(
    window_log=19, hash_log=17, chain_log=17, search_log=3, min_match=4, target_length=16,
    strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_dict_id=False,
)
#: A margin under this share of the winner's bytes is narrow.
NARROW = 0.004
UND = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")


def normalise(text: str | None) -> bytes:
    """Lower-cased letters, everything else one space; empty without a letter."""
    if not text:
        return b""
    out = _NO_LETTERS.sub(" ", text.lower()).strip()
    return out.encode("utf-8", "replace") if re.search("[a-z]", out) or any(c.isalpha() for c in out) else b""


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, bytes]:
    """One raw-content dictionary per non-null language of ``docs``, from about SAMPLE_DOCS documents each.

    The sample is a hash range sized from exact counts, so that only it leaves the executors: the
    counts, one for each language of the model, come first, and no text is shuffled for them.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    unit = (F.xxhash64(F.col(key), F.lit(17)).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
    rows = known.select(F.col(lang).alias("__lang"), F.col(text).alias("__text"), unit.alias("__u"))
    counts = {r["__lang"]: r["n"] for r in rows.groupBy("__lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(SAMPLE_DOCS / n))])
    picked = rows.where(F.col("__u") < F.element_at(share, F.col("__lang"))).select("__lang", "__u", F.substring("__text", 1, SAMPLE_BYTES).alias("__text"))
    parts: dict[str, list[tuple[float, bytes]]] = {k: [] for k in counts}
    for r in picked.collect():
        parts[r["__lang"]].append((r["__u"], normalise(r["__text"])))
    return {k: b" ".join(x for _, x in sorted(v)) for k, v in sorted(parts.items())}


class Identifier:
    """The compressors of a fitted model, made once in each task."""

    def __init__(self, model: dict[str, bytes]):
        self.langs = sorted(model)
        self.compressors = []
        for k in self.langs:
            d = zstandard.ZstdCompressionDict(model[k] or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=PARAMS)
            self.compressors.append(zstandard.ZstdCompressor(compression_params=PARAMS, dict_data=d))

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, rejected)."""
        data = normalise(text)
        if not data or not self.langs:
            return UND, 0.0, True
        ranked = sorted(zip(self.sizes(data), self.langs))
        if len(ranked) == 1:
            return ranked[0][1], 1.0, False
        (best, name), (second, _) = ranked[:2]
        margin = (second - best) / second
        return name, min(1.0, 0.5 + 2.0 * margin), margin < NARROW


def identify(docs: DataFrame, model: dict[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_rejected; no other column is read for them."""
    bundle = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fit, per language
    fields = [f for f in docs.schema.fields if f.name.lower() not in ("lang_pred", "lang_score", "lang_rejected")]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Identifier(bundle.value)
        for b in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            found = [judge(x) for x in b.column(text).to_pylist()]
            cols = [b.column(n) for n in names]
            cols += [pa.array([x[i] for x in found], t) for i, t in ((0, pa.string()), (1, pa.float64()), (2, pa.bool_()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "lang_pred", "lang_score", "lang_rejected"])

    small_batches(docs.sparkSession)
    return docs.select(*names).mapInArrow(releasing(run), schema)
