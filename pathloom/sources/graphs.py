"""Edge-labelled graphs: text triples, Parquet, CSV or any DataFrame; loaders of annotated edges; simple statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """``edges`` (src, label, dst), a set.  ``vertices`` (v) overrides the vertex domain; ``part`` names a column that no walk crosses: edges of different
    parts share no vertex.  The edges whose part is null are one part."""

    edges: DataFrame
    vertices: DataFrame | None = None
    part: str | None = None
    dense: bool = False

    @classmethod
    def from_frame(cls, df: DataFrame, src: str = "src", label: str = "label", dst: str = "dst", part: str | None = None, vertices: DataFrame | None = None, dense: bool = False) -> "Graph":
        """Rows with a null end or label are no edges; duplicates collapse where facts are made."""
        own = [F.col(src).alias("src"), F.col(label).alias("label"), F.col(dst).alias("dst"), *([F.col(part).alias("part")] if part else [])]
        edges = df.select(*own).where(F.col("src").isNotNull() & F.col("label").isNotNull() & F.col("dst").isNotNull())
        return cls(edges, vertices, "part" if part else None, dense)

    @classmethod
    def from_text(cls, spark: SparkSession, path: str) -> "Graph":
        """Lines ``src label dst`` with non-negative integer ends, blanks between; anything else fails the query that reads it.

        The vertex domain is 0 to the largest id.
        """
        words = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
        bad = (F.size("w") != 3) | ~F.col("w")[0].rlike(r"^\d+$") | ~F.col("w")[2].rlike(r"^\d+$")
        checked = F.when(bad, F.raise_error(F.concat(F.lit("not a triple: "), F.col("value"))).cast("array<string>")).otherwise(F.col("w"))
        rows = spark.read.text(path).select("value", words.alias("w")).select(checked.alias("w"))
        return cls(rows.select(F.col("w")[0].cast("long").alias("src"), F.col("w")[1].alias("label"), F.col("w")[2].cast("long").alias("dst")).distinct(), dense=True)

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, **columns) -> "Graph":
        return cls.from_frame(spark.read.parquet(path), **columns)

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, **columns) -> "Graph":
        return cls.from_frame(spark.read.csv(path, header=True, inferSchema=True), **columns)

    def write(self, path: str) -> None:
        """Parquet by label, so that a query reads the files of its own labels only."""
        self.edges.repartition("label").write.mode("overwrite").partitionBy("label").parquet(path)

    def write_text(self, path: str) -> None:
        self.edges.select(F.concat_ws(" ", F.col("src"), "label", F.col("dst"))).write.mode("overwrite").text(path)

    def domain(self) -> DataFrame:
        """The vertices (v) that have the empty walk."""
        if self.vertices is not None:
            return self.vertices.select(F.col(self.vertices.columns[0]).alias("v")).distinct()
        if self.dense:
            n = self.vertex_count()
            return self.edges.sparkSession.range(n).select(F.col("id").alias("v"))
        return self.edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()

    def vertex_count(self) -> int:
        """Size of the domain: largest id + 1 if ids are dense."""
        if self.dense:
            return (self.edges.agg(F.max(F.greatest("src", "dst")).alias("m")).first()["m"] + 1) if not self.edges.isEmpty() else 0
        return self.domain().count()

    def edge_count(self) -> int:
        """Distinct edges; an edge under two labels counts twice."""
        return self.edges.select("src", "label", "dst").distinct().count()

    def label_counts(self) -> DataFrame:
        return self.edges.select("src", "label", "dst").distinct().groupBy("label").agg(F.count("*").alias("n_edges"))

    def with_witness_columns(self) -> DataFrame:
        """Edges as facts of height and length 1 whose midpoint is their source."""
        return self.edges.select("src", "label", "dst").distinct().withColumns({"mid": F.col("src"), "height": F.lit(1), "length": F.lit(1).cast("long")})

    def with_length_columns(self) -> DataFrame:
        return self.edges.select("src", "label", "dst").distinct().withColumns({"mid": F.col("src"), "length": F.lit(1).cast("long")})

    def __add__(self, other: "Graph") -> "Graph":
        """Union of the edges."""
        return Graph(self.edges.select("src", "label", "dst").unionByName(other.edges.select("src", "label", "dst")).distinct(), dense=self.dense and other.dense)

    def joined(self, other: "Graph") -> "Graph":
        """Union if both have edges, else none: the conjunction of two partial walks."""
        a, b = self.edges.select("src", "label", "dst"), other.edges.select("src", "label", "dst")
        one = lambda df: df.limit(1).select(F.lit(1).alias("one"))
        gate = one(a).join(one(b), "one")
        both = a.unionByName(b).distinct().withColumn("one", F.lit(1))
        return Graph(both.join(F.broadcast(gate), "one", "left_semi").drop("one"), dense=self.dense and other.dense)


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def batches(vertices: DataFrame, size: int, v: str = "v") -> DataFrame:
    """(v, batch): dense vertex ids in runs of ``size``."""
    return vertices.withColumn("batch", F.floor(F.col(v) / size))


def transposed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), "label", F.col("src").alias("dst"))
