"""Records that hold template residue, filler, error pages or demands for scripts instead of content.

Three kinds of evidence are combined, none of them a list of phrases. (1) Form: placeholders,
instructions in brackets, repetition, markup without a record (residue_rules). (2) Words: texts
whose form tells what they are give the languages of records, pages, filler and instructions, as
numbers of texts by word over the whole corpus; a sentence belongs to the language its words weigh
for. Terms of the address slug and of the changed paths weigh against a page, and a message that
shares none of them and consists of words hardly any other record uses is filler. (3) Hosts: a
text without layout that its words leave undecided weighs the more for a page the more hosts serve
the same. The text is read twice: for the languages, whose size is bounded, and for the verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, release
from .residue_rules import RARE, SURE, Model, Tally, examine, parts_of, skeleton

#: Hosts that serve the same page, at least.
HOSTS = 3
#: Words a task holds before it hands on its counts.
HELD = 1 << 19

_COUNTS = ("df", "record", "page", "filler", "ask")
_FOUND = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("kind", pa.string()), ("place", pa.string()), ("score", pa.float64()), ("page", pa.int64())])


def language_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, df, record, page, filler, ask): records a word is in, and texts of each language; the null word has those of all.

    Counted within tasks before anything is shuffled. Results of any parts of a corpus, days or
    sources, can be kept, united and added up by word.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(tally.keys(), pa.string()), *[pa.array(c, pa.int64()) for c in zip(*tally.values())]], names=["word", *_COUNTS])

        for b in batches:
            for x in b.column(0):
                if (s := x.as_py()) and s.strip():
                    tally.add(parts_of(s))
            if len(tally) > HELD:
                yield rows()
                tally.clear()
        if tally:
            yield rows()

    own = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(counted, "word string, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    return own.groupBy("word").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def learn(table: DataFrame) -> Model:
    """The model of language_counts(). Of the words only those come to the driver that are in more than RARE of the records or of the texts of pages, filler or instructions: at most 2,000 times the words of a text, whatever the number of records."""
    table = cut(table)
    all_ = table.where("word is null").first()
    if all_ is None:
        return Model({})
    records, _, *totals = all_[1:]
    keep = (F.col("df") > max(2, RARE * records)) | F.lit(False)
    for c, n in zip(_COUNTS[2:], totals):
        keep = keep | (F.col(c) > RARE * n)
    rows = table.where(keep & F.col("word").isNotNull()).collect()
    release(table)
    return Model({None: tuple(all_[1:])} | {r[0]: tuple(r[1:]) for r in rows})


def residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "repo", model: Model | None = None) -> DataFrame:
    """(doc_id, kind, place, hosts) of each record that is residue; one row for each such row of ``docs``.

    ``kind`` is unfilled, ask (an instruction to the author), filler, error or script; ``place`` is
    text, message or diff; ``hosts`` is the number of hosts that serve the same text, null where it
    is not the whole. Null and empty texts are none. Null hosts count as no host. Ids are bigints
    and may repeat. ``model`` is that of ``docs`` if none is given. In fewer than about 500 records
    no word is known to be rare, and filler of unknown words is not found.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{text}`").cast("string").alias("text"))
    content = docs.sparkSession.sparkContext.broadcast(model or learn(language_counts(rows)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = content.value
        for b in batches:
            out = []
            for doc, own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (x.as_py() for x in b.column(2))):
                if not text or not text.strip():
                    continue
                v = examine(parts_of(text), own, m)
                whole = v.place == "text" or not v.kind and v.score is not None
                if v.kind or whole:
                    out.append((doc, own, v.kind, v.place, v.score, xxhash.xxh64_intdigest(skeleton(text)) - (1 << 63) if whole else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND)], schema=_FOUND)

    # of the corpus only what is residue or may be is left
    seen = cut(rows.mapInArrow(found, "doc_id bigint, host string, kind string, place string, score double, page bigint"))
    pages = seen.where("page is not null").groupBy("page", "host").agg(F.lit(1).alias("n")).groupBy("page").agg(F.count("host").alias("hosts"))
    whole = seen.where("page is not null").join(pages, "page")
    served = F.col("kind").isin("", "filler") & (F.col("hosts") >= HOSTS) & (F.col("score") + 2 * F.log(F.greatest("hosts", F.lit(1)).cast("double")) > SURE)
    whole = whole.where(served | (F.col("kind") != "")).select("doc_id", F.when(served, "error").otherwise(F.col("kind")).alias("kind"), F.when(served, "text").otherwise(F.col("place")).alias("place"), "hosts")
    parts = seen.where("page is null").select("doc_id", "kind", "place", F.lit(None).cast("bigint").alias("hosts"))
    return whole.unionByName(parts)


def without_residue(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the records whose id is in ``found``; rows with a null id stay.

    Ids of residue are some percent of those of all records and may be many, so whether they are
    broadcast is left to Spark, which knows their size when it runs.
    """
    return docs.join(found.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")
