"""Queries over sources, sinks and row transforms (inventory 2.1 to 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkmill.functions import codes, text
from larkmill.functions.chance import uniform, uniform_sql
from larkmill.operators import joins, sequence
from larkmill.operators.ranking import hash_order
from larkmill.sources import files

from .base import Tables, query

HIST = "SELECT user_id, list(item_id ORDER BY pos) AS s FROM b_seq GROUP BY user_id"


def hist(t: Tables):
    return sequence.histories(t.seq).withColumnRenamed("items", "s")


@query("src_03_csv_scan", "SELECT p_partkey, p_size FROM part")
def _(t):
    return files.through_csv(t.part.select("p_partkey", "p_name", "p_size"), "p_partkey bigint, p_name string, p_size int").select("p_partkey", "p_size")


@query("src_05_filtered_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t):
    rows = files.through_csv(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey bigint, o_custkey bigint", sep="\t")
    return rows.join(t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("src_06_parquet_scan", "SELECT l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def _(t):
    return t.lineitem.where("l_quantity > 45").select("l_partkey", "l_quantity")


@query("src_09_csv_columns", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    return files.through_csv(t.nation, "n_nationkey int, n_name string, n_regionkey int", sep="|").select("n_nationkey", "n_name")


@query("src_11_embedding_table", "SELECT item_id, len(e) AS dims, round(list_sum(e), 6) AS total FROM b_emb")
def _(t):
    return t.emb.select("item_id", F.size("e").cast("bigint").alias("dims"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("src_12_split_tables", "SELECT split, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items FROM b_loo GROUP BY split")
def _(t):
    return t.loo.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("item_id").alias("items"))


SNAP = "SELECT w, user_id, item_id, ts, CASE WHEN chunk + 1 < w - 1 THEN 'train' WHEN chunk + 1 = w - 1 THEN 'val' ELSE 'test' END AS split FROM b_chunk, (VALUES (3), (4), (5)) x(w) WHERE chunk + 1 <= w"


@query("src_13_window_table", f"SELECT split, count(*) AS n FROM ({SNAP}) WHERE w = 4 GROUP BY split")
def _(t):
    return sequence.snapshots(t.chunked).where("w = 4").groupBy("split").agg(F.count("*").alias("n"))


@query("src_21_hash_shuffle", "SELECT event_id, md5(concat(event_id, '|7')) AS h FROM events")
def _(t):
    return t.events.select("event_id", hash_order("event_id", "7").alias("h")).orderBy("h", "event_id")


@query("snk_02_item_text", "SELECT p_partkey AS item_id, CASE WHEN trim(t) = '' THEN 'item ' || p_partkey ELSE t END AS text FROM (SELECT p_partkey, CASE WHEN p_size = 1 THEN ' ' ELSE p_name END AS t FROM part)")
def _(t):
    s = F.when(F.col("p_size") == 1, " ").otherwise(F.col("p_name"))
    return t.part.select(F.col("p_partkey").alias("item_id"), files.item_text(s, F.col("p_partkey")).alias("text"))


@query("snk_03_sequences_last_30", f"WITH h AS ({HIST}) SELECT user_id, list_slice(s, -30, -1) AS items FROM h WHERE len(s) >= 2")
def _(t):
    return hist(t).where(F.size("s") >= 2).select("user_id", sequence.trim_last(F.col("s"), 30).alias("items"))


@query("snk_04_window_export", f"WITH s AS ({SNAP}), h AS (SELECT user_id, list(item_id ORDER BY ts) AS s FROM s WHERE w = 3 AND split = 'train' GROUP BY user_id), g AS (SELECT user_id, arg_min(item_id, ts) AS target FROM s WHERE w = 3 AND split = 'test' GROUP BY user_id) SELECT user_id, list_append(list_slice(s, -30, -1), target) AS items FROM h JOIN g USING (user_id)")
def _(t):
    w = sequence.snapshots(t.chunked).where("w = 3")
    h = w.where("split = 'train'").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "item_id"))), lambda x: x["item_id"]).alias("s"))
    g = w.where("split = 'test'").groupBy("user_id").agg(F.min_by("item_id", "ts").alias("target"))
    return h.join(g, "user_id").select("user_id", F.concat(sequence.trim_last(F.col("s"), 30), F.array("target")).alias("items"))


@query("snk_05_interactions_long", "SELECT user_id, pos AS position, item_id, split FROM b_loo")
def _(t):
    return t.loo.select("user_id", F.col("pos").alias("position"), "item_id", "split")


@query("snk_06_sid_summary", "SELECT 'unique' AS name, count(*) AS n FROM (SELECT 1 FROM b_sid GROUP BY c1, c2, c3 HAVING count(*) = 1) UNION ALL SELECT 'collided', count(*) FROM (SELECT count(*) OVER (PARTITION BY c1, c2, c3) AS k FROM b_sid) WHERE k > 1 UNION ALL SELECT 'largest', max(k) FROM (SELECT count(*) AS k FROM b_sid GROUP BY c1, c2, c3)")
def _(t):
    k = t.sid.groupBy("c1", "c2", "c3").agg(F.count("*").alias("k")).agg(F.sum((F.col("k") == 1).cast("bigint")).alias("unique"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("collided"), F.max("k").alias("largest"))
    return k.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in k.columns))).alias("x")).select("x.*")


@query("snk_09_dense_scatter", "SELECT p_partkey AS item_id, coalesce(e, list_transform(range(64), lambda x: 0.0::DOUBLE)) AS e FROM part LEFT JOIN b_emb ON p_partkey = item_id AND item_id % 3 <> 0")
def _(t):
    return joins.scatter(t.parts, t.emb.where("item_id % 3 <> 0").select("item_id", "e"), "item_id", "e", 64)


@query("snk_10_prediction_dump", "SELECT user_id, rank - 1 AS place, item_id FROM b_pred")
def _(t):
    lists = t.pred.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias("items"))
    return lists.select("user_id", F.posexplode("items").alias("place", "item_id")).withColumn("place", F.col("place").cast("bigint"))


@query("prj_01_rename", "SELECT l_partkey AS item, l_quantity AS amount FROM lineitem")
def _(t):
    return t.lineitem.select("l_partkey", "l_quantity").withColumnsRenamed({"l_partkey": "item", "l_quantity": "amount"})


@query("prj_03_typed_cast", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, try_cast(event_type AS BIGINT) AS bad FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.col("event_type").try_cast("bigint").alias("bad"))


@query("prj_04_bytes_to_text", "SELECT p_partkey, p_name AS name FROM part")
def _(t):
    return t.part.select("p_partkey", F.decode(F.encode("p_name", "UTF-8"), "UTF-8").alias("name"))


@query("prj_05_min_length", f"WITH h AS ({HIST}) SELECT user_id, len(s) AS n FROM h WHERE len(s) >= 20")
def _(t):
    return hist(t).where(F.size("s") >= 20).select("user_id", F.size("s").cast("bigint").alias("n"))


@query("prj_06_non_empty", f"WITH h AS ({HIST}), f AS (SELECT user_id, list_filter(s, lambda x: x % 7 = 0) AS s FROM h) SELECT * FROM f WHERE len(s) > 0")
def _(t):
    return hist(t).select("user_id", F.filter("s", lambda x: x % 7 == 0).alias("s")).where(F.size("s") > 0)


SIDSEQ = "SELECT q.user_id, flatten(list([c1, c2, c3] ORDER BY q.pos)) AS codes FROM b_seq q JOIN b_sid s ON q.item_id = s.item_id GROUP BY q.user_id"


@query("prj_07_sid_sequences", SIDSEQ)
def _(t):
    return joins.code_sequences(t.seq, t.sid, ["c1", "c2", "c3"])


@query("prj_08_trim", f"WITH h AS ({HIST}) SELECT user_id, list_slice(s, -10, -1) AS last, list_slice(s, 1, 10) AS first FROM h")
def _(t):
    return hist(t).select("user_id", sequence.trim_last(F.col("s"), 10).alias("last"), F.slice("s", 1, 10).alias("first"))


@query("prj_09_padded_tokens", "SELECT p_partkey, list_concat(list_slice(w, 1, 4), list_transform(range(greatest(0, 4 - len(w))), lambda x: '')) AS tokens, list_transform(range(4), lambda i: i < len(w)) AS mask FROM (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part)")
def _(t):
    w = t.part.select("p_partkey", F.split(F.lower("p_name"), " ").alias("w"))
    return w.select("p_partkey", F.concat(F.slice("w", 1, 4), F.array_repeat(F.lit(""), F.greatest(F.lit(0), 4 - F.size("w")))).alias("tokens"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: i < F.size("w")).alias("mask"))


@query("prj_10_category_index", "WITH d AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS idx FROM (SELECT DISTINCT p_type FROM part WHERE p_size > 25)) SELECT p_partkey, coalesce(idx, 0) AS idx FROM part LEFT JOIN d USING (p_type)")
def _(t):
    d = sequence.dense_ids(t.part.where("p_size > 25"), "p_type", "idx").withColumn("idx", F.col("idx") + 1)
    return t.part.join(F.broadcast(d), "p_type", "left").select("p_partkey", F.coalesce("idx", F.lit(0)).cast("bigint").alias("idx"))


@query("prj_11_embedding_lookup", "SELECT q.user_id, q.pos, round(e[1], 6) AS x FROM b_seq q JOIN b_emb m ON q.item_id = m.item_id")
def _(t):
    return t.seq.join(t.emb, "item_id").select("user_id", "pos", F.round(F.col("e")[0], 6).alias("x"))


@query("prj_13_token_offset", f"WITH h AS ({HIST}) SELECT user_id, list_transform(s, lambda x: x + 3) AS s FROM h")
def _(t):
    checked = F.when(F.exists("s", lambda x: x < 0), F.raise_error(F.lit("negative token"))).otherwise(F.transform("s", lambda x: x + 3))
    return hist(t).select("user_id", checked.alias("s"))


@query("prj_14_drop_oov_aligned", "SELECT user_id, list(item_id ORDER BY pos) FILTER (item_id % 10 <> 0) AS items, list(pos ORDER BY pos) FILTER (item_id % 10 <> 0) AS places FROM b_seq GROUP BY user_id HAVING count(*) FILTER (item_id % 10 <> 0) > 0")
def _(t):
    h = t.seq.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "item_id"))).alias("z")).select("user_id", F.filter("z", lambda x: x["item_id"] % 10 != 0).alias("z"))
    return h.where(F.size("z") > 0).select("user_id", F.transform("z", lambda x: x["item_id"]).alias("items"), F.transform("z", lambda x: x["pos"]).alias("places"))


@query("prj_15_all_oov", f"WITH h AS ({HIST}) SELECT user_id FROM h WHERE len(list_filter(s, lambda x: x % 5 = 0)) > 0")
def _(t):
    return hist(t).where(F.exists("s", lambda x: x % 5 == 0)).select("user_id")


@query("prj_16_float_list", "SELECT item_id, round(list_sum(e), 4) AS total FROM b_emb")
def _(t):
    parsed = t.emb.select("item_id", F.split(F.array_join(F.transform("e", lambda x: x.cast("string")), ","), ",").cast("array<double>").alias("e"))
    return parsed.select("item_id", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("prj_17_category_paths", "SELECT p_partkey, array_to_string(list_sort(list_distinct([p_type, p_brand, p_type, 'all'])), ' ') AS path FROM part")
def _(t):
    return t.part.select("p_partkey", text.flatten_paths(F.array(F.array("p_type", "p_brand"), F.array(F.col("p_type"), F.lit("all")))).alias("path"))


@query("prj_18_item_text", "SELECT p_partkey, trim(concat_ws(' ', nullif(p_name, ''), CASE WHEN p_size % 2 = 0 THEN p_brand END, nullif(p_type, ''))) AS text FROM part")
def _(t):
    return t.part.select("p_partkey", text.compose(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.col("p_type")).alias("text"))


@query("prj_19_first_rank", "SELECT p_partkey, least(p_brand, p_type) AS category, CASE WHEN p_brand < p_type THEN p_size ELSE p_size + 1 END AS rank FROM part")
def _(t):
    m = F.create_map("p_brand", "p_size", F.col("p_type"), F.col("p_size") + 1)
    first = F.array_min(F.transform(F.map_entries(m), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))))
    return t.part.select("p_partkey", first["key"].alias("category"), first["value"].alias("rank"))


@query("prj_20_text_length", "SELECT doc_id, length(text) AS n, substr(text, 1, 20) AS head FROM documents")
def _(t):
    return t.documents.select("doc_id", F.length("text").cast("bigint").alias("n"), F.substring("text", 1, 20).alias("head"))


@query("prj_21_level_offset", f"WITH q AS ({SIDSEQ}) SELECT user_id, list_transform(codes, lambda x, i: x + ((i - 1) % 3) * 257) AS codes FROM q")
def _(t):
    return joins.code_sequences(t.seq, t.sid, ["c1", "c2", "c3"]).select("user_id", codes.add_level_offset(F.col("codes"), 3, 257).alias("codes"))


@query("prj_22_offset_removal", SIDSEQ)
def _(t):
    shifted = joins.code_sequences(t.seq, t.sid, ["c1", "c2", "c3"]).select("user_id", codes.add_level_offset(F.col("codes"), 3, 257).alias("codes"))
    return shifted.select("user_id", codes.remove_level_offset(F.col("codes"), 3, 257).alias("codes"))


@query("prj_23_separators", f"WITH q AS ({SIDSEQ}) SELECT user_id, flatten(list_transform(range(1, len(codes) + 1, 3), lambda i: list_append(list_slice(codes, i, i + 2), 999))) AS codes FROM q")
def _(t):
    q = joins.code_sequences(t.seq, t.sid, ["c1", "c2", "c3"]).select("user_id", F.col("codes").cast("array<bigint>").alias("codes"))
    return q.select("user_id", codes.with_separators(F.col("codes"), 3, 999).alias("codes"))


@query("prj_24_user_bins", "SELECT DISTINCT user_id, user_id % 64 AS bin FROM b_seq")
def _(t):
    return t.seq.select("user_id", F.pmod("user_id", F.lit(64)).alias("bin")).distinct()


@query("prj_25_pad", f"WITH h AS ({HIST}) SELECT user_id, list_concat(list_slice(s, -40, -1), list_transform(range(greatest(0, 40 - len(s))), lambda x: 0)) AS s FROM h")
def _(t):
    return hist(t).select("user_id", sequence.pad(sequence.trim_last(F.col("s"), 40), 40).alias("s"))


@query("prj_26_strip_html", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def _(t):
    return t.pages.select("page_id", text.strip_tags(F.col("html")).alias("text"))


TOKENS = "list_filter(string_split(regexp_replace(lower({}), '[^a-zà-ÿ]+', ' ', 'g'), ' '), lambda x: x <> '')"
STOPS = "['the', 'and', 'of', 'a', 'is', 'in', 'to', 'for', 'with']"


@query("prj_27_token_set", f"SELECT conv_id, turn, list_sort(list_distinct(list_filter({TOKENS.format('text')}, lambda x: NOT list_contains({STOPS}, x)))) AS tokens FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", F.array_sort(F.array_distinct(text.tokens(F.col("text"), text.STOP))).alias("tokens"))


@query("prj_28_labels", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'normal' ELSE 'rich' END AS level FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "normal").otherwise("rich").alias("level"))


@query("prj_29_first_match", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'jewel' WHEN contains(p_name, 'widget') THEN 'device' WHEN contains(p_name, 'small') THEN 'small' ELSE 'other' END AS class FROM part")
def _(t):
    return t.part.select("p_partkey", text.first_match(F.col("p_name"), [("ring", "jewel"), ("widget", "device"), ("small", "small")], "other").alias("class"))


@query("prj_30_title", f"SELECT p_partkey, array_to_string(list_filter({TOKENS.format('p_name')}, lambda x: NOT list_contains(['small', 'red'], x)), ' ') AS title FROM part")
def _(t):
    return t.part.select("p_partkey", F.array_join(text.tokens(F.col("p_name"), ["small", "red"]), " ").alias("title"))


@query("prj_31_prefix_flag", "SELECT n_nationkey, starts_with(lower(trim(n_name)), 'nation_1') AS flag FROM nation")
def _(t):
    return t.nation.select("n_nationkey", F.startswith(F.lower(F.trim("n_name")), F.lit("nation_1")).alias("flag"))


@query("prj_32_templates", f"SELECT p_partkey, CASE floor(3 * {uniform_sql('p_partkey', 3)})::INT WHEN 0 THEN p_name || ', brand ' || p_brand WHEN 1 THEN p_name || ' of type ' || p_type ELSE 'size ' || p_size || ' ' || p_name END AS text FROM part")
def _(t):
    forms = F.array(F.format_string("%s, brand %s", "p_name", "p_brand"), F.format_string("%s of type %s", "p_name", "p_type"), F.format_string("size %d %s", "p_size", "p_name"))
    return t.part.select("p_partkey", forms[F.floor(3 * uniform("p_partkey", seed=3)).cast("int")].alias("text"))


@query("prj_33_join_and", "SELECT r_regionkey, CASE len(l) WHEN 0 THEN '' WHEN 1 THEN l[1] ELSE array_to_string(l[1:-2], ', ') || ' and ' || l[-1] END AS names FROM (SELECT r_regionkey, coalesce(list(n_name ORDER BY n_name) FILTER (n_name IS NOT NULL), []) AS l FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey)")
def _(t):
    names = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy("r_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    return names.select("r_regionkey", text.join_and(F.col("l")).alias("names"))


