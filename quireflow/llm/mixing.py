"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Every document of a source has the same expected number of copies, target / words of the source. Within the source these expectations are
summed in order of size, one offset is added, and a document is taken once for each integer that its sum crosses; in order of size, the words
taken come near the target too. The order is dealt into cells (source, size band, hash of the id), so that the sums inside a cell and over
the cells of a source are both short, however many documents one source has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tables

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds target to a table (source, source_size) of one row per source.

    Sources by code point, null last, weigh weights, repeating; together they get share times all words. A target stops at most times the
    source's words and the excess is reshared by weight. So the targets are least(most * words, level * weight) for one level: in order of
    most * words / weight, a source is stopped if the level that the rest would have is not below that. The table has a row per source, not per document.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    before = W.orderBy("at", "place").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(0))
    weighed = sources.withColumn("place", F.row_number().over(order))
    weighed = weighed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")))
    weighed = weighed.withColumn("most", F.lit(most) * F.col("source_size")).withColumn("at", F.col("most") / F.col("weight"))
    rest = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))
    level = rest / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    weighed = weighed.withColumn("level", level).withColumn("free", F.col("level") < F.col("at"))
    first = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(W.orderBy("at", "place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return weighed.select("source", "source_size", F.least(F.col("most").cast("double"), F.coalesce(first * F.col("weight"), F.col("most").cast("double"))).alias("target"))


def _unit(text: Column) -> Column:
    """A number in [0, 1) from 32 bits of a hash."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: (doc_id, source, size, source_size, target, copies, taken, *keep).

    size counts the words of the whole text (null: 0), copies says how often the mix holds the document (0 too), taken = copies * size. A source's
    taken words differ from its target by no more than about the size of its largest document.
    Documents with a null source are a source of their own; those with a null id take part. A source without words has target 0 and is not
    taken. Repeated rows count one by one; equal sizes and ids are in no fixed order, which changes nothing that is returned but which of equal rows is taken.
    Reruns agree: offsets and cells are hashes of source, id and seed. An empty table gives an empty result; extra columns are ignored.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)])
    bits = F.length(F.bin("size"))
    band = F.when(F.col("size") < 16, F.col("size")).otherwise(bits * 8 + F.floor(F.col("size") / F.pow(F.lit(2.0), bits - 4)) % 8).cast("int")
    part = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))), 1, 2)
    sized = tables.written(sized.withColumns({"band": band, "part": part}), "sizes")  # words are counted once, for three uses
    cells = sized.groupBy("source", "band", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    per_source = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    before = W.partitionBy("source").orderBy("band", "part").rowsBetween(W.unboundedPreceding, -1)  # 256 parts of some 500 bands at most
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cells = cells.alias("c").join(per_source.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("c.source", "band", "part", "before", "source_size", "target")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ranked = sized.withColumn("rank", F.row_number().over(W.partitionBy("source", "band", "part").orderBy("size", "doc_id")))
    same = F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.band") == F.col("c.band")) & (F.col("d.part") == F.col("c.part"))
    out = ranked.alias("d").join(cells.alias("c"), same).select("doc_id", "d.source", "size", "source_size", "target", (F.col("before") + F.col("rank")).alias("place"), *[f"__k{i}" for i in range(len(keep))])
    offset = _unit(F.concat(F.lit(seed), F.lit("/"), F.coalesce(F.col("source"), F.lit(""))))
    copies = (F.floor(F.col("place") * each + offset) - F.floor((F.col("place") - 1) * each + offset)).cast("long")
    return out.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)])


def draw(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copy_col: str = "copy", **how) -> DataFrame:
    """The mix itself: every row of docs as often as mix() takes it, with all its columns and the number of the copy, from 1, in copy_col.

    Rows that are the same in every column count one by one in mix(), and are given out together. All columns must be of types that Spark can hash. Null
    and empty texts have size 0: they cost the mix nothing and are taken as mix() says. An empty table gives an empty result.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumns({"__h1": F.xxhash64(*columns), "__h2": F.xxhash64(F.lit(1), *columns)})
    rows = mix(keyed, id_col=id_col, text_col=text_col, source_col=source_col, keep=("__h1", "__h2"), **how)
    taken = tables.written(rows.groupBy("__h1", "__h2").agg(F.sum("copies").cast("int").alias("__copies"), F.count("*").alias("__rows")).where("__copies > 0"), "taken")
    once = keyed.join(taken.where("__rows = 1").hint("shuffle_hash"), ["__h1", "__h2"])  # texts are not sorted for it
    if not taken.where("__rows > 1").isEmpty():
        once = once.unionByName(keyed.join(taken.where("__rows > 1"), ["__h1", "__h2"]).dropDuplicates(["__h1", "__h2"]))
    return once.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias(copy_col))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(tables.read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_MIX = r"""
sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}),
celled AS (
  SELECT *, CASE WHEN size < 16 THEN size ELSE length(bin(size)) * 8 + (size // pow(2, length(bin(size)) - 4)::BIGINT) % 8 END AS band,
         substr(md5('mix' || coalesce(doc_id::VARCHAR, '-')), 1, 2) AS part FROM sized),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM per_source),
weighed AS (SELECT *, [3, 1, 2][(place - 1) % 3 + 1] AS weight, 2 * source_size AS most, 2 * source_size / [3, 1, 2][(place - 1) % 3 + 1] AS ratio FROM placed),
levels AS (
  SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(most) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT arg_min(level, (ratio, place)) AS level FROM levels WHERE level < ratio),
targets AS (SELECT source, source_size, least(most::DOUBLE, coalesce(free.level * weight, most::DOUBLE)) AS target FROM levels LEFT JOIN free ON true),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY band, part, size, doc_id) AS place FROM celled),
mixed AS (
  SELECT doc_id, ranked.source, size, source_size, target, place,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS each,
         ('0x' || substr(md5('mix/' || coalesce(ranked.source, '')), 1, 8))::BIGINT / 4294967296e0 AS off
  FROM ranked JOIN targets ON ranked.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, ((floor(place * each + off) - floor((place - 1) * each + off)) * size)::BIGINT AS taken FROM mixed"""

QUERIES = {"op4_mixing": op4_mixing}
ORACLES = {"op4_mixing": "WITH " + _MIX.replace("{docs}", "documents").lstrip()}
