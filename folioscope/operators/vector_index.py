"""A clustered vector index in versions, and searches that read few of its cells.

Vectors of a scope are dealt to cells around centroids; a cell is one partition folder of the stored table, so a
search reads the folders it needs and no others. The angle between a query and any vector of a cell is at least the
angle to the centroid less the cell's radius, which bounds the cosine: with it ``search`` widens until the result
is exact, or stops after a fixed number of cells. Where vectors have no clusters (independent directions in many
dimensions) such bounds rule out little and an exact search reads nearly all cells.

Centroids come from spherical k-means over a bounded sample of each large scope: ``SAMPLE_A_CELL`` vectors a cell,
``MOST_CELLS`` cells at most, chosen by a hash of the id; every vector is then assigned and stored. Scopes with no
more rows than a cell is meant to hold have no centroids and share cells, so many small scopes don't make as many
folders. Work is cut into blocks of bounded rows, also where one cell or one scope holds most of the table.

Cases: vectors that are null, empty, zero or hold a null or non-finite component, and those without a scope, are in no
cell; vectors of other lengths than the query are not compared; equal vectors tie and the smallest id comes first;
an empty table gives an index in which nothing is found.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.scalar import cosine
from folioscope.operators.probing import probe
from folioscope.sources.scratch import settled
from folioscope.sources.tables import activate, active_version, write_version

ROWS_A_CELL, SAMPLE_A_CELL, MOST_CELLS, ROUNDS = 4096, 64, 1024, 12
#: Rows and queries that meet in one task.
ROWS_A_TASK, QUERIES_A_TASK = 20_000, 4_096
#: Cosines are compared to so many decimals, below which sums differ by the order in which they are added.
DECIMALS = 12


def usable(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_list()).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _train(sample: pd.DataFrame) -> pd.DataFrame:
    """Centroids of one scope by spherical k-means, from the most distant starts of a seeded walk."""
    x, k = _unit(sample.sort_values("id").vector), int(sample.k.iloc[0])
    rng = np.random.default_rng(len(x))
    centres = [x[rng.integers(len(x))]]
    far = x @ centres[0]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[rng.choice(np.flatnonzero(far <= np.quantile(far, 0.1)))])
        far = np.maximum(far, x @ centres[-1])
    c = np.stack(centres)
    for _ in range(ROUNDS):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return pd.DataFrame({"scope": sample.scope.iloc[0], "size": sample["size"].iloc[0], "no": np.arange(len(c), dtype=np.int32), "centroid": list(c)})


def _assign(rows: pd.DataFrame, centroids: pd.DataFrame) -> pd.DataFrame:
    """Rows of one scope with the number of their centroid and the angle to it."""
    if rows.empty:
        return pd.DataFrame({"id": [], "scope": [], "size": [], "vector": [], "no": [], "angle": []})
    c = centroids.sort_values("no")
    seen = _unit(rows.vector) @ np.stack(c.centroid.to_list()).T
    near = np.argmax(seen, axis=1)
    angle = np.arccos(np.clip(seen[np.arange(len(near)), near], -1, 1))
    return pd.DataFrame({"id": rows.id, "scope": rows.scope, "size": rows["size"], "vector": rows.vector, "no": c.no.to_numpy()[near], "angle": angle})


def build_index(
    vectors: DataFrame, path: str, version: str, id_col: str = "vec_id", vector_col: str = "embedding", scope_col: str = "label",
    rows_a_cell: int = ROWS_A_CELL,
) -> None:
    """Write a version of the index and, once it is whole, make it the active one."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(scope_col).alias("scope"), F.col(vector_col).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("scope").isNotNull() & usable(F.col("vector"))).withColumn("size", F.size("vector"))
    keys = ["scope", "size"]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("k", F.least(F.ceil(F.col("n") / rows_a_cell), F.lit(MOST_CELLS)).cast("int"))
    sizes = settled(sizes.withColumn("salts", F.ceil(F.col("n") / ROWS_A_TASK).cast("int")))
    large, small = sizes.where("k > 1"), sizes.where("k = 1")
    met = rows.join(large, keys)
    share = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    kind, of = rows.schema["scope"].dataType.simpleString(), rows.schema["vector"].dataType.simpleString()
    centroids = settled(
        met.where(share < F.lit(2.0 * SAMPLE_A_CELL) * F.col("k") / F.col("n")).select("id", *keys, "vector", "k")
        .groupBy(*keys).applyInPandas(_train, f"scope {kind}, size int, no int, centroid array<double>")
    )
    left = met.select("id", *keys, "vector", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    right = centroids.join(large, keys).select(*keys, "no", "centroid", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    near = left.groupBy(*keys, "salt").cogroup(right.groupBy(*keys, "salt")).applyInPandas(_assign, f"id long, scope {kind}, size int, vector {of}, no int, angle double")
    shared = max(1, math.ceil((small.agg(F.sum("n")).first()[0] or 0) / rows_a_cell))
    few = rows.join(small.select(*keys), keys).select("id", *keys, "vector", F.lit(None).cast("int").alias("no"), F.lit(math.pi).alias("angle"))
    own = F.concat(F.lower(F.hex(F.xxhash64(*keys))), F.lit("-"), F.col("no"))
    cell = F.coalesce(own, F.concat(F.lit("shared-"), F.pmod(F.xxhash64(*keys), F.lit(shared))))
    placed = settled(near.unionByName(few).withColumn("cell", cell))
    cells = placed.groupBy(*keys, "no", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    cells = cells.join(centroids, [*keys, "no"], "left").select(*keys, "cell", "n", "radius", "centroid")
    write_version(cells, f"{path}/cells", version)
    write_version(placed.select("id", *keys, "vector", "cell").hint("rebalance", "cell"), f"{path}/vectors", version, ["cell"])
    activate(spark, path, version)


def _meet(k: int, skip_self: bool):
    """The best ``k`` rows of a block of a cell for each of a block of queries, within their scope."""

    def of(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        asked, ids, scores = [], [], []
        for (scope, size), mine in queries.groupby(["scope", "size"]) if len(rows) and len(queries) else ():
            there = rows[(rows.scope == scope) & (rows["size"] == size)]
            if there.empty:
                continue
            seen = np.round(_unit(mine.vector) @ _unit(there.vector).T, DECIMALS) + 0.0
            names = there.id.to_numpy()
            if skip_self:
                seen[mine.query_id.to_numpy()[:, None] == names[None, :]] = -np.inf
            least = np.partition(seen, -k, axis=1)[:, -k] if seen.shape[1] > k else np.full(len(seen), -2.0)
            for query, row, low in zip(mine.query_id.to_numpy(), seen, np.maximum(least, -2.0)):
                at = np.flatnonzero(row >= low)
                at = at[np.lexsort((names[at], -row[at]))][:k]
                asked.append(np.full(len(at), query))
                ids.append(names[at])
                scores.append(row[at])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pd.DataFrame({"query_id": join(asked, np.int64), "id": join(ids, np.int64), "score": join(scores, float)})

    return of


def search(
    spark: SparkSession, path: str, queries: DataFrame, k: int, first: int = 4, exact: bool = True, skip_self: bool = True,
    id_col: str = "vec_id", vector_col: str = "embedding", scope_col: str = "label", seen: dict[str, int] | None = None,
) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` nearest of each query's scope by cosine, from the active version.

    ``queries`` has an id, a vector and a scope. With ``exact`` cells are read until no other can hold a better vector;
    without, the ``first`` cells only. ``seen``, if given, gets the rows of the cells that were read and of all that a scan of
    the queries' scopes would read.
    """
    version = active_version(spark, path)
    if version is None:
        raise ValueError(f"no active version under {path}")
    cells = spark.read.parquet(f"{path}/cells/version={version}")
    stored = f"{path}/vectors/version={version}"
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(scope_col).alias("scope"), F.col(vector_col).alias("vector"))
    asked = asked.where(F.col("query_id").isNotNull() & F.col("scope").isNotNull() & usable(F.col("vector"))).withColumn("size", F.size("vector"))
    keys = ["scope", "size"]
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col("vector"), F.col("centroid")))))
    bound = F.when(F.col("centroid").isNull(), F.lit(1.0)).otherwise(F.cos(F.greatest(F.lit(0.0), angle - F.col("radius"))))
    bounds = asked.join(cells, keys).select("query_id", "cell", bound.alias("bound"))
    rows_of = cells.groupBy("cell").agg(F.sum("n").alias("rows"))

    def scan(due: DataFrame) -> DataFrame:
        names = [r.cell for r in due.select("cell").distinct().collect()]  # at most one row a cell of the index
        if not names:
            return spark.createDataFrame([], "query_id long, id long, score double")
        blocks = due.groupBy("cell").agg(F.count("*").alias("asked")).join(rows_of, "cell").select(
            "cell", F.ceil(F.col("rows") / ROWS_A_TASK).cast("int").alias("parts"), F.ceil(F.col("asked") / QUERIES_A_TASK).cast("int").alias("groups")
        )
        rows = spark.read.parquet(stored).where(F.col("cell").isin(names)).join(blocks, "cell")
        rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("group", F.explode(F.expr("sequence(0, groups - 1)")))
        mine = due.join(asked, "query_id").join(blocks, "cell").withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int"))
        mine = mine.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        block = ["cell", "part", "group"]
        left = rows.select(*block, "id", *keys, "vector").groupBy(*block)
        right = mine.select(*block, "query_id", *keys, "vector").groupBy(*block)
        return left.cogroup(right).applyInPandas(_meet(k, skip_self), "query_id long, id long, score double")

    best, rounds = probe(bounds, scan, k, first, "id", 10.0**-9, exact)
    if seen is not None:
        read = [due.select("cell").distinct().join(rows_of, "cell").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] for due in rounds]
        seen |= {"read": sum(read), "scan": asked.select(*keys).distinct().join(cells, keys).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]}
    return best
