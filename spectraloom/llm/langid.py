"""Language identification by compression.

A language is a zstandard raw-content dictionary of its sample texts. A text is
split into blocks, each block is compressed with every dictionary, and the
language with the fewest bytes in all wins; a narrow margin is a rejection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import tidied

#: Answer for a text without letters.
UNDETERMINED = "und"
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample and of the decision.

    sample_docs: labelled rows that a language is learnt from (those of least
    hash of id and text), whole texts of them. max_languages: more labelled
    languages than this are an error, as each is a dictionary in every task.
    block_bytes: a text is compressed in blocks of this size, so that a long
    text cannot learn from itself. min_margin: a smaller lead of the best
    language over the next, as a share of the best size, is a rejection.
    """

    sample_docs: int = 48
    max_languages: int = 1024
    block_bytes: int = 2048
    level: int = 6
    sharpness: float = 0.25
    min_margin: float = 0.002


def letters(text: str) -> str:
    """Lower-cased letters and their marks; each run of anything else is a space. Empty without a letter."""
    return _OTHER.sub(" ", text.lower()).strip() if _LETTER.search(text) else ""


def fit(labelled: DataFrame, settings: Settings = Settings()) -> dict[str, bytes]:
    """Dictionaries by language from rows (doc_id, text, lang), most frequent language first.

    Rows with a null text or lang are left out; an empty table gives no
    language. The driver gets ``sample_docs`` whole texts a language.
    """
    rows = labelled.filter("text is not null and lang is not null").select("doc_id", "lang", "text")
    langs = [r[0] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(settings.max_languages + 1).collect()]
    if len(langs) > settings.max_languages:
        raise ValueError(f"more than {settings.max_languages} languages")
    if not langs:
        return {}
    named = rows.withColumn("order", F.xxhash64("doc_id", "text"))
    # The least of each 64th of a language come first, so that no task orders all of a language's rows.
    chosen = named.select("lang", "order", "doc_id").distinct().withColumn("part", F.pmod("order", F.lit(64)))
    for by in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*by).orderBy("order", "doc_id")
        chosen = chosen.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= settings.sample_docs)
    # At most sample_docs small rows a language.
    sample = named.join(F.broadcast(chosen.select("lang", "order")), ["lang", "order"]).dropDuplicates(["lang", "order"])
    texts: dict[str, list[str]] = {x: [] for x in langs}
    for r in sorted(sample.select("lang", "order", "text").collect()):
        if t := letters(r.text):
            texts[r.lang].append(t)
    made = {x: " ".join(dict.fromkeys(t)).encode() for x, t in texts.items()}
    return {x: b for x, b in made.items() if len(b) >= 8}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], settings: Settings = Settings()):
        self.settings, self.langs, self._by = settings, list(dictionaries), []
        for data in dictionaries.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=settings.level)
            self._by.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int] | None:
        """Compressed bytes by language, None without letters."""
        data = letters(text).encode()
        if not data:
            return None
        step = self.settings.block_bytes
        blocks = [data[i : i + step] for i in range(0, len(data), step)]
        return [sum(len(f(b)) for b in blocks) for f in self._by]

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin, accepted; equal sizes go to the more frequent language."""
        sizes = self.sizes(text) if text and self.langs else None
        if sizes is None:
            return UNDETERMINED, 0.0, 0.0, False
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for i, s in enumerate(sizes) if i != best]
        margin = (min(rest) - sizes[best]) / sizes[best] if rest else 1.0
        score = 1 / (1 + sum(math.exp(-self.settings.sharpness * (s - sizes[best])) for s in rest))
        return self.langs[best], score, margin, margin >= self.settings.min_margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], settings: Settings = Settings()) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score, margin, accepted.

    One map over whole texts, no shuffle. A null text or one without letters is
    ``und`` with score 0 and is not accepted; repeated rows are answered alike;
    a text of any length is read whole, block by block; equal sizes go to the
    language with more labelled rows. Other columns, whatever their names, are
    not read.
    """

    @tidied
    def work(batches):
        model = Classifier(dictionaries, settings)
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column("text")]
            columns = list(zip(*found, strict=True)) if found else [[]] * 4
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "lang_pred", "score", "margin", "accepted"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double, margin double, accepted boolean")


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the classifier accepts; decided where the text is read."""

    @tidied
    def work(batches):
        model = Classifier(dictionaries, settings)
        for b in batches:
            keep = [model.predict(t.as_py())[3] for t in b.column("text")]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
