"""Long spans that stand verbatim in more than one document.

The paragraphs compared are all passages of MIN_CHARS code points, wherever they begin. A passage's
MinHash is the least hash of its GRAM-character shingles, taken with one band of one row: like
passages have like minima, so banding finds every verbatim passage, and more rows could only lose
some. Neighbouring passages share their minima, hence a document stores about 2 / (MIN_CHARS -
GRAM) places a character instead of a signature a passage. Documents that collide in a band are
verified on the exact text around the shared place, and components over the verified spans give
the clusters within which copies can be removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.kernels import code_points, prefix_sums, runs, sliding_min, span_hash
from foliospark.session import cut

MIN_CHARS, GRAM = 240, 60
#: A place shared in more different surroundings than this is resolved by its passages, not by comparing surroundings.
CROWD = 48

PLACE = T.StructType([T.StructField("doc", T.LongType()), T.StructField("band", T.LongType()), T.StructField("pos", T.IntegerType())])


def minima(texts: list[str], span: int = MIN_CHARS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, position, hash) of each place that is the minimum of a passage of `span` characters."""
    codes = code_points("\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    empty = np.zeros(0, np.int64)
    if len(codes) < span:
        return empty, empty, empty.astype(np.uint64)
    at = np.arange(len(codes) - gram + 1)
    hashes = span_hash(prefix_sums(codes), at, at + gram)
    bits = np.uint64(max(1, int(len(codes)).bit_length()))
    keyed = (hashes >> bits << bits) | at.astype(np.uint64)
    least = sliding_min(keyed, span - gram + 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.concatenate(([0], ends))))[: len(codes)]
    whole = owner[: len(least)] == owner[span - 1 : span - 1 + len(least)]
    whole &= np.arange(len(least)) + span <= (ends - 1)[owner[: len(least)]]
    chosen = np.unique(least[whole] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    texts_of = owner[chosen]
    return texts_of, chosen - (ends - [len(t) + 1 for t in texts])[texts_of], hashes[chosen]


def places(corpus: DataFrame, doc: str, text: str, span: int, gram: int) -> DataFrame:
    """(doc, band, pos): the minima of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, part in runs(batch.column(1).to_pylist()):
                index, at, hashes = minima(part, span, gram)
                yield pa.RecordBatch.from_arrays([pa.array(ids[first + index]), pa.array(hashes.view(np.int64)), pa.array(at.astype(np.int32))], PLACE.names)

    return _source(corpus, doc, text, span).mapInArrow(run, PLACE)


def _source(corpus: DataFrame, doc: str, text: str, span: int) -> DataFrame:
    return corpus.select(corpus[doc].cast("long").alias("doc"), corpus[text].alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= span))


def surroundings(corpus: DataFrame, doc: str = "doc_id", text: str = "text", span: int = MIN_CHARS, gram: int = GRAM) -> DataFrame:
    """(doc, pos, band, lead, around, context): the places whose band several documents have, with the text around.

    `around` holds all passages through the place, `lead` of its characters lie before the place,
    and context is a digest of both. Texts are joined only to documents that have such a place."""
    found = cut(places(corpus, doc, text, span, gram))
    shared = found.groupBy("band").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("band")
    wanted = found.join(shared, "band").groupBy("doc").agg(F.collect_list(F.struct("band", "pos")).alias("at"))
    reach = span - gram
    texts = _source(corpus, doc, text, span).join(wanted, "doc")
    lead = F.least(F.col("p.pos"), F.lit(reach))
    at = texts.select("doc", "text", F.explode("at").alias("p")).select("doc", F.col("p.pos").alias("pos"), F.col("p.band").alias("band"), lead.alias("lead"), F.expr(f"substring(text, p.pos - least(p.pos, {reach}) + 1, least(p.pos, {reach}) + {span})").alias("around"))
    return cut(at.withColumn("context", F.sha2(F.concat(F.col("lead").cast("string"), F.lit(":"), F.col("around")), 256)))


def reaches(lead: int, around: str, other_lead: int, other: str) -> tuple[int, int]:
    """How far two surroundings agree before and after their place."""
    left = len(commonprefix([around[:lead][::-1], other[:other_lead][::-1]]))
    return left, len(commonprefix([around[lead:], other[other_lead:]]))


VERIFIED = T.StructType([T.StructField("band", T.LongType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType())])


def verified_contexts(at: DataFrame, span: int = MIN_CHARS, gram: int = GRAM, crowd: int = CROWD, pairs: bool = True) -> DataFrame:
    """(band, a, b, before, after): different contexts of one place that share a passage, and how far they agree.

    Without `pairs`, each context of a large group is linked to the least context of each passage
    that it shares instead of to all that share it. Such links cover and connect the same, and
    there are at most as many as a context has passages, whatever the size of the group.

    A group of at most `crowd` different contexts is compared as a whole. In a larger one the
    passages through the place are hashed instead: contexts with a passage in common meet under its
    digest, whatever the size of the group, and no others are compared."""
    contexts = at.groupBy("band", "context").agg(F.first("lead").alias("lead"), F.first("around").alias("around"))
    sizes = contexts.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    sized = contexts.join(sizes, "band")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for band, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, x in enumerate(group):
                    for y in group[i + 1 :]:
                        left, right = reaches(x["lead"], x["around"], y["lead"], y["around"])
                        if left + right >= span:
                            out.append((band, *sorted((x["context"], y["context"])), left, right))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()])], VERIFIED.names)

    few = sized.where(F.col("n") <= crowd).groupBy("band").agg(F.collect_list(F.struct("context", "lead", "around")).alias("all")).mapInArrow(run, VERIFIED)
    passages = sized.where(F.col("n") > crowd).select("band", "context", "lead", F.explode(F.expr(f"transform(sequence(0, least(lead, length(around) - {span})), i -> struct(lead - i AS back, sha2(substring(around, i + 1, {span}), 256) AS passage))")).alias("p"))
    keyed = passages.select("band", "context", F.col("p.back").alias("back"), F.col("p.passage").alias("passage"))
    if pairs:
        met = keyed.alias("x").join(keyed.alias("y"), ["band", "passage", "back"]).where("x.context < y.context")
    else:
        least = keyed.groupBy("band", "passage", "back").agg(F.min("context").alias("context"), F.max("context").alias("most")).where("context < most").drop("most")
        met = least.alias("x").join(keyed.alias("y"), ["band", "passage", "back"]).where("x.context < y.context")
    many = met.groupBy("band", F.col("x.context").alias("a"), F.col("y.context").alias("b")).agg(F.max("back").cast("int").alias("before"), (F.lit(span) - F.min("back")).cast("int").alias("after"))
    return few.unionByName(many)


def shared_pairs(at: DataFrame, verified: DataFrame, span: int = MIN_CHARS) -> DataFrame:
    """(doc_id_a, doc_id_b), doc_id_a < doc_id_b: the pairs of documents that share a passage."""
    own = at.where(F.length("around") >= span).select("band", "context", "doc").distinct()
    alike = own.groupBy("band", "context").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y").select("band", F.col("context").alias("a"), F.col("context").alias("b"))
    links = verified.select("band", "a", "b").unionByName(alike)
    left, right = own.select("band", F.col("context").alias("a"), F.col("doc").alias("m")), own.select("band", F.col("context").alias("b"), F.col("doc").alias("n"))
    met = links.join(left, ["band", "a"]).join(right, ["band", "b"]).where("m <> n")
    return met.select(F.least("m", "n").alias("doc_id_a"), F.greatest("m", "n").alias("doc_id_b")).distinct()


def shared_share(corpus: DataFrame, at: DataFrame, verified: DataFrame, doc: str = "doc_id", text: str = "text", span: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share) of every document: how much of it stands elsewhere in passages of `span`.

    Null and empty texts have 0 of 0 and share 0."""
    many = at.groupBy("band", "context").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y")
    whole = many.join(at.select("band", "context", "lead", F.length("around").alias("size")).distinct(), ["band", "context"])
    reach = (
        verified.select("band", F.col("a").alias("context"), "before", "after")
        .unionByName(verified.select("band", F.col("b").alias("context"), "before", "after"))
        .unionByName(whole.where(F.col("size") >= span).select("band", "context", F.col("lead").alias("before"), (F.col("size") - F.col("lead")).alias("after")))
        .groupBy("band", "context")
        .agg(F.max("before").alias("before"), F.max("after").alias("after"))
    )
    spans = at.join(reach, ["band", "context"]).select("doc", (F.col("pos") - F.col("before")).alias("s"), (F.col("pos") + F.col("after")).alias("e"))
    # a document's spans are at most its length over a few: summed in one fold of their sorted array
    folded = spans.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("all"))
    total = F.expr("aggregate(all, struct(0 AS n, -1 AS e), (acc, x) -> struct(acc.n + greatest(0, x.e - greatest(x.s, acc.e)) AS n, greatest(acc.e, x.e) AS e), acc -> acc.n)")
    covered = folded.select("doc", total.cast("long").alias("shared_chars"))
    every = corpus.select(corpus[doc].cast("long").alias("doc_id"), F.coalesce(F.length(corpus[text]), F.lit(0)).cast("long").alias("n_chars"))
    joined = every.join(covered, every["doc_id"] == covered["doc"], "left")
    shared = F.coalesce("shared_chars", F.lit(0).cast("long"))
    return joined.select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("share"))


def components(at: DataFrame, verified: DataFrame, rounds: int = 64) -> DataFrame:
    """(doc_id, component): documents linked by shared passages, each under the least id of its component.

    Links run from documents to contexts and between contexts, never between all documents of a
    group. Every round each side takes the least label of the other, then of its label's holder, so
    the rounds needed grow with the logarithm of a chain's length in the common case; it ends when
    nothing changes, and raises if `rounds` do not suffice."""
    linked = verified.select("band", F.col("a").alias("context"), F.col("b").alias("to")).unionByName(verified.select("band", F.col("b").alias("context"), F.col("a").alias("to")))
    own = at.select("doc", "band", "context").distinct()
    nodes = F.sha2(F.concat_ws("|", F.col("band").cast("string"), F.col("context")), 256)
    to = F.sha2(F.concat_ws("|", F.col("band").cast("string"), F.col("to")), 256)
    base = own.select("doc", nodes.alias("node"))
    extra = own.join(linked, ["band", "context"]).select("doc", to.alias("node"))
    edges = cut(base.unionByName(extra).distinct())
    shared = edges.groupBy("node").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y").select("node")
    edges = cut(edges.join(shared, "node"))
    labels = cut(edges.select("doc", F.col("doc").alias("label")).distinct())
    for _ in range(rounds):
        of_node = edges.join(labels, "doc").groupBy("node").agg(F.min("label").alias("label"))
        heard = edges.join(of_node, "node").groupBy("doc").agg(F.min("label").alias("label"))
        jumped = heard.join(labels.select(F.col("doc").alias("label"), F.col("label").alias("next")), "label", "left")
        fresh = cut(jumped.select("doc", F.coalesce("next", "label").alias("label")))
        changed = fresh.join(labels.withColumnRenamed("label", "was"), "doc").where("label <> was").limit(1).count()
        labels = fresh
        if not changed:
            return labels.select(F.col("doc").alias("doc_id"), F.col("label").alias("component"))
    raise RuntimeError(f"components have not settled after {rounds} rounds")
