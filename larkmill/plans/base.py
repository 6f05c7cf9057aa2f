"""Registration of queries, base relations in Spark and the same relations as DuckDB common table expressions."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkmill.operators import graph, ranking, recommend, sequence, vector
from larkmill.operators.staging import staged

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Centroids of one level of the fixed codebook: embeddings with vec_id in [level * CODES, (level + 1) * CODES).
CODES, LEVELS = 16, 3
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


class Tables:
    """Input tables and relations derived from them, lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def inter(self) -> DataFrame:
        return self.orders.join(self.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("o_orderdate").alias("ts"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"))

    @cached_property
    def seq(self) -> DataFrame:
        return sequence.positions(self.inter, ["ts", "ok", "ln", "item_id"]).select("user_id", "item_id", "ts", "pos", "n")

    @cached_property
    def loo(self) -> DataFrame:
        return staged(sequence.leave_one_out(self.seq), "loo")

    @cached_property
    def train(self) -> DataFrame:
        return self.loo.where("split = 'train'").select("user_id", "item_id", "pos")

    @cached_property
    def test(self) -> DataFrame:
        return self.loo.where("split = 'test'").select("user_id", "item_id")

    @cached_property
    def parts(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("item_id"))

    @cached_property
    def counts(self) -> DataFrame:
        return sequence.item_counts(self.train, self.parts)

    @cached_property
    def pred(self) -> DataFrame:
        return staged(recommend.most_popular(self.counts, self.train, self.test.select("user_id").distinct(), 50), "pred")

    @cached_property
    def ev(self) -> DataFrame:
        kind = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")) - 1
        return self.events.select("event_id", "user_id", (F.get_json_object("props", "$.k").cast("bigint") * 5 + kind).alias("item_id"), "ts", "event_type", "value")

    @cached_property
    def chunked(self) -> DataFrame:
        return staged(sequence.count_windows(self.ev, "ts", 5), "chunked")

    @cached_property
    def ecat(self) -> DataFrame:
        return self.spark.range(510).select(F.col("id").alias("item_id"))

    @cached_property
    def etrain(self) -> DataFrame:
        return self.chunked.where("chunk = 0").select("user_id", "item_id", "ts", "event_id")

    @cached_property
    def etarget(self) -> DataFrame:
        return self.chunked.where("chunk = 4").select("user_id", "item_id").distinct()

    @cached_property
    def ecounts(self) -> DataFrame:
        return sequence.item_counts(self.etrain, self.ecat)

    @cached_property
    def epred(self) -> DataFrame:
        return staged(recommend.most_popular(self.ecounts, self.etrain, self.etarget.select("user_id").distinct(), 200), "pred")

    @cached_property
    def edges(self) -> DataFrame:
        return graph.typed_edges(self.lineitem, self.seq, self.part)

    @cached_property
    def wedges(self) -> DataFrame:
        return graph.undirected_weights(self.edges)

    @cached_property
    def near_wedges(self) -> DataFrame:
        """Of wedges, those between items with a vector: all that means of neighbours' vectors need."""
        return graph.undirected_weights(graph.typed_edges(self.lineitem, self.seq, self.part, self.emb))

    @cached_property
    def emb(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("e"), "label")

    @cached_property
    def codebook(self) -> DataFrame:
        return self.emb.where(F.col("item_id") < CODES * LEVELS).select(F.floor(F.col("item_id") / CODES).cast("int").alias("level"), (F.col("item_id") % CODES).cast("int").alias("code"), F.col("e").alias("centroid"))

    @cached_property
    def sid(self) -> DataFrame:
        return vector.with_serial(vector.residual_codes(self.emb.select("item_id", "e"), self.codebook, LEVELS).select("item_id", *(f"c{k + 1}" for k in range(LEVELS))), [f"c{k + 1}" for k in range(LEVELS)])


#: Base relations of the oracles; each is put into WITH where its name occurs.
CTES = {
    "b_inter": "SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS ts, l_orderkey AS ok, l_linenumber AS ln FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "b_seq": "SELECT user_id, item_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, ok, ln, item_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM b_inter",
    "b_loo": "SELECT *, CASE WHEN pos = n - 1 THEN 'test' WHEN pos = n - 2 THEN 'val' ELSE 'train' END AS split FROM b_seq WHERE n >= 3",
    "b_train": "SELECT user_id, item_id, pos FROM b_loo WHERE split = 'train'",
    "b_test": "SELECT user_id, item_id FROM b_loo WHERE split = 'test'",
    "b_counts": "SELECT p_partkey AS item_id, count(t.item_id) AS cnt FROM part LEFT JOIN b_train t ON p_partkey = t.item_id GROUP BY p_partkey",
    "b_pred": """SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, item_id) AS rank FROM (
        SELECT u.user_id, c.item_id, c.cnt FROM (SELECT DISTINCT user_id FROM b_test) u, (SELECT *, row_number() OVER (ORDER BY cnt DESC, item_id) AS r FROM b_counts) c
        WHERE r <= 50 + (SELECT max(k) FROM (SELECT count(DISTINCT item_id) AS k FROM b_train GROUP BY user_id)) AND NOT EXISTS (SELECT 1 FROM b_train t WHERE t.user_id = u.user_id AND t.item_id = c.item_id)) QUALIFY rank <= 50""",
    "b_ev": "SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) * 5 + list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS item_id, ts, event_type, value FROM events",
    "b_evr": "SELECT *, row_number() OVER (ORDER BY ts) - 1 AS r, count(*) OVER () AS total FROM b_ev",
    "b_cuts": "SELECT i, (SELECT ts FROM b_evr WHERE r = CAST(floor(total * i / 5.0) AS BIGINT)) AS cut FROM range(1, 5) x(i)",
    "b_chunk": "SELECT e.event_id, user_id, item_id, ts, event_type, value, (SELECT count(*) FROM b_cuts WHERE cut <= e.ts) AS chunk FROM b_ev e",
    "b_ecat": "SELECT range AS item_id FROM range(510)",
    "b_etrain": "SELECT user_id, item_id, ts, event_id FROM b_chunk WHERE chunk = 0",
    "b_etarget": "SELECT DISTINCT user_id, item_id FROM b_chunk WHERE chunk = 4",
    "b_ecounts": "SELECT c.item_id, count(t.item_id) AS cnt FROM b_ecat c LEFT JOIN b_etrain t USING (item_id) GROUP BY c.item_id",
    "b_epred": "SELECT u.user_id, c.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY cnt DESC, c.item_id) AS rank FROM (SELECT DISTINCT user_id FROM b_etarget) u, b_ecounts c WHERE NOT EXISTS (SELECT 1 FROM b_etrain t WHERE t.user_id = u.user_id AND t.item_id = c.item_id) QUALIFY rank <= 200",
    "b_edges": """SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst, 'bought_together' AS relation FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey
        UNION ALL SELECT DISTINCT a.item_id, b.item_id, 'also_bought' FROM b_seq a JOIN b_seq b ON a.user_id = b.user_id AND b.pos = a.pos + 1 AND a.item_id <> b.item_id
        UNION ALL SELECT DISTINCT a.p_partkey, b.p_partkey, 'also_viewed' FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey""",
    "b_wedges": "SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, CASE relation WHEN 'bought_together' THEN 2.0::DOUBLE WHEN 'also_bought' THEN 1.0 ELSE 0.6 END AS w FROM b_edges UNION ALL SELECT dst, src, CASE relation WHEN 'bought_together' THEN 2.0::DOUBLE WHEN 'also_bought' THEN 1.0 ELSE 0.6 END FROM b_edges) GROUP BY src, dst",
    "b_emb": "SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings",
    "b_code": f"SELECT item_id // {CODES} AS level, item_id % {CODES} AS code, e AS centroid FROM b_emb WHERE item_id < {CODES * LEVELS}",
    "b_r1": "SELECT item_id, e AS r FROM b_emb",
    **{f"b_a{k}": f"SELECT item_id, arg_min(code, (d, code)) AS code, arg_min(centroid, (d, code)) AS centroid, any_value(r) AS r FROM (SELECT x.item_id, x.r, c.code, c.centroid, round(list_sum(list_transform(list_zip(x.r, c.centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS d FROM b_r{k} x JOIN b_code c ON c.level = {k - 1}) GROUP BY item_id" for k in (1, 2, 3)},
    **{f"b_r{k}": f"SELECT item_id, list_transform(list_zip(r, centroid), lambda z: z[1] - z[2]) AS r FROM b_a{k - 1}" for k in (2, 3, 4)},
    "b_sid": "SELECT item_id, CAST(a.code AS INT) AS c1, CAST(b.code AS INT) AS c2, CAST(c.code AS INT) AS c3, CAST(row_number() OVER (PARTITION BY a.code, b.code, c.code ORDER BY item_id) - 1 AS INT) AS dis FROM b_a1 a JOIN b_a2 b USING (item_id) JOIN b_a3 c USING (item_id)",
}


def with_ctes(body: str) -> str:
    """body with the base relations it names, and those they name, in order of use."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bb_[a-z]+\d?\b", text):
            if name in CTES and name not in order:
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    head = ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)
    own = re.match(r"\s*WITH\s+", body)
    return f"WITH {head}, {body[own.end():]}" if own else f"WITH {head} {body}"


def query(name: str, sql: str | None = None):
    """Registers a function of Tables as a query, with its oracle."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return f

    return register


__all__ = ["CODES", "CTES", "LEVELS", "ORACLES", "QUERIES", "Tables", "query", "graph", "ranking", "recommend", "sequence", "vector"]
