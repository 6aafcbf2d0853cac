"""Text preparation, files, generation, trained models and streams."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from .. import schema, streaming
from ..operators import explain, features, metrics, textdata
from ..plans import models, network, pipelines
from ..session import discard, fresh_path, materialize
from ..sources import files, sample_view
from ..sources.keyed_store import KeyedStore
from .base import ORACLES, query, round_sql, tidy, tx, with_tx
from .graph_queries import GRAPH_NAMES, with_graph
from .model_queries import _SPLIT as SPLIT_SQL, _SPLIT_NAMES as SPLIT_NAMES
from .quality_queries import _bad as bad_rows, defective

# ---- text records -----------------------------------------------------------------------


def raw_records(spark, sf_dir):
    """Documents as JSON records of every accepted shape, and some of none."""
    docs = sample_view.table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 6
    turns = F.array(F.struct(F.lit("user").alias("role"), F.col("source").alias("content")),
                    F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")))
    record = (
        F.when(k == 0, F.to_json(F.struct(turns.alias("messages"), F.col("text").alias("text"))))
        .when(k == 1, F.to_json(F.struct(F.col("source").alias("prompt"), F.col("text").alias("completion"))))
        .when(k == 2, F.to_json(F.struct(F.col("text").alias("text"))))
        .when(k == 3, F.to_json(F.struct(F.col("lang").alias("instruction"), F.col("source").alias("input"), F.col("text").alias("output"))))
        .when(k == 4, F.to_json(F.struct(F.col("lang").alias("instruction"), F.lit("").alias("input"), F.col("text").alias("output"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("body")))))
    return docs.select("doc_id", record.alias("record"))


@query("text_instruction_records", """select doc_id, case doc_id % 6 when 0 then 'messages' when 1 then 'completion' when 2 then 'text' when 5 then null else 'instruction' end as shape,
 case when doc_id % 6 = 0 then source when doc_id % 6 = 3 then concat(lang, chr(10), chr(10), 'Input:', chr(10), source) when doc_id % 6 = 4 then lang end as first_content,
 case when doc_id % 6 in (0, 3, 4) then text end as last_content, case when doc_id % 6 = 1 then source end as prompt,
 case when doc_id % 6 = 1 then text end as completion, case when doc_id % 6 = 2 then text end as text from documents""")
def _instruction(spark, sf_dir):
    out = textdata.normalize_instruction(raw_records(spark, sf_dir))
    return out.select("doc_id", "shape", F.col("messages")[0]["content"].alias("first_content"),
                      F.col("messages")[1]["content"].alias("last_content"), "prompt", "completion", "text")


def preference_records(spark, sf_dir):
    docs = sample_view.table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 3
    record = (
        F.when(k == 0, F.to_json(F.struct(F.col("source").alias("prompt"), F.col("text").alias("chosen"), F.col("lang").alias("rejected"))))
        .when(k == 1, F.to_json(F.struct(F.col("source").alias("instruction"), F.col("lang").alias("chosen"), F.col("text").alias("rejected"))))
        .otherwise(F.to_json(F.struct(F.col("source").alias("prompt"), F.col("text").alias("chosen")))))
    return docs.select("doc_id", record.alias("record"))


@query("text_preference_records", """select doc_id, case doc_id % 3 when 0 then 'preference' when 1 then 'instruction' end as shape,
 case when doc_id % 3 < 2 then source end as prompt, case doc_id % 3 when 0 then text when 1 then lang end as chosen,
 case doc_id % 3 when 0 then lang when 1 then text end as rejected from documents""")
def _preference(spark, sf_dir):
    out = textdata.normalize_preference(preference_records(spark, sf_dir))

    def content(c):
        return F.when(F.col("shape") == "instruction", F.get_json_object(c, "$[0].content")).otherwise(F.col(c)).alias(c)

    return out.select("doc_id", "shape", content("prompt"), content("chosen"), content("rejected"))


@query("text_preference_coverage", "select case when text = lang then 'identical' when length(c) < length(r) then 'chosen_shorter' "
       "when length(c) > length(r) then 'chosen_longer' else 'same_length' end as kind, count(*) as pairs from (select text, lang, "
       "case doc_id % 3 when 0 then text else lang end as c, case doc_id % 3 when 0 then lang else text end as r from documents "
       "where doc_id % 3 < 2) as q group by 1")
def _coverage(spark, sf_dir):
    docs = sample_view.table(spark, sf_dir, "documents").where("doc_id % 3 < 2")
    first = F.col("doc_id") % 3 == 0
    return textdata.preference_coverage(docs.select(
        F.when(first, F.col("text")).otherwise(F.col("lang")).alias("chosen"),
        F.when(first, F.col("lang")).otherwise(F.col("text")).alias("rejected")))


def _dialogs(turns, max_turns):
    return textdata.conversation_messages(turns, max_turns).select("conv_id", "part", F.size("messages").cast("bigint").alias("turns"), F.concat_ws(
        "\n", F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))).alias("dialog"))


@query("text_conversations", "select conv_id, (turn // 10000)::bigint as part, count(*) as turns, "
       "string_agg(concat(role, ':', text), chr(10) order by turn, role, text) as dialog from conversations group by 1, 2")
def _conversations(spark, sf_dir):
    return _dialogs(sample_view.table(spark, sf_dir, "conversations"), 10_000)


_ORDER_TURNS = ("select l_suppkey % 2 as conv_id, l_orderkey * 8 + l_linenumber as turn, l_returnflag as role, "
                "cast(l_partkey as varchar) as text from lineitem")


@query("text_conversation_parts", "select conv_id::bigint as conv_id, (turn // 10000)::bigint as part, count(*) as turns, "
       f"string_agg(concat(role, ':', text), chr(10) order by turn, role, text) as dialog from ({_ORDER_TURNS}) as t group by 1, 2")
def _conversation_parts(spark, sf_dir):
    """Two conversations over all order lines, far longer than one record may be."""
    lines = sample_view.table(spark, sf_dir, "lineitem")
    turns = lines.selectExpr("cast(l_suppkey % 2 as bigint) as conv_id", "l_orderkey * 8 + l_linenumber as turn", "l_returnflag as role",
                             "cast(l_partkey as string) as text")
    return _dialogs(turns, 10_000)


def _mask_sql(text):
    for name, pattern in textdata.PERSONAL:
        text = f"regexp_replace({text}, '{pattern}', '[{name}]', 'g')"
    return text


@query("text_masked", f"select doc_id, {_mask_sql('text')} as text, substring(sha256(concat('s', cast(doc_id as varchar))), 1, 16) as token from documents")
def _masked(spark, sf_dir):
    docs = sample_view.table(spark, sf_dir, "documents")
    return docs.select("doc_id", textdata.mask_personal(F.col("text")).alias("text"),
                       textdata.tokenize_id(F.col("doc_id"), "s").alias("token"))


_HELD = "case when cast(concat('0x', substring(sha256(cast(doc_id as varchar)), 1, 8)) as bigint) % 10 = 0 then 'held_out' else 'train' end"


@query("text_held_out", f"select doc_id, {_HELD} as split from documents")
def _held_out(spark, sf_dir):
    return sample_view.table(spark, sf_dir, "documents").select("doc_id", textdata.held_out(F.col("doc_id")).alias("split"))


@query("text_class_coverage", f"select split, sum((toxic = 1)::int)::bigint as positive, sum((toxic = 0)::int)::bigint as negative, "
       f"sum((toxic = 1)::int) > 0 and sum((toxic = 0)::int) > 0 as both_present from (select *, {_HELD} as split from labels) as q group by 1")
def _classes(spark, sf_dir):
    rows = sample_view.table(spark, sf_dir, "labels").withColumn("split", textdata.held_out(F.col("doc_id")))
    return textdata.class_coverage(rows, "toxic")


@query("text_report_prompts", with_tx(
    f"select transaction_id, 2::bigint as parts, 'system' as first_role, channel, label_is_fraud = 1 as is_fraud, currency as account_currency, "
    f"'{textdata.REPORT_INSTRUCTION}' as instruction from tx", "transaction_id", "channel", "label_is_fraud", "currency"))
def _prompts(spark, sf_dir):
    df = tx(spark, sf_dir).select("transaction_id", "channel", "label_is_fraud", "currency")
    out = textdata.report_prompts(df, F.struct("transaction_id", "channel"),
                                  F.struct((F.col("label_is_fraud") == 1).alias("is_fraud")), F.struct("currency"))
    body = F.col("messages")[1]["content"]
    return out.select(
        F.get_json_object(body, "$.transaction.transaction_id").alias("transaction_id"),
        F.size("messages").cast("bigint").alias("parts"), F.col("messages")[0]["role"].alias("first_role"),
        F.get_json_object(body, "$.transaction.channel").alias("channel"),
        F.get_json_object(body, "$.classification_result.is_fraud").cast("boolean").alias("is_fraud"),
        F.get_json_object(body, "$.customer_context.currency").alias("account_currency"),
        F.get_json_object(body, "$.report_instruction").alias("instruction"))


# ---- files ------------------------------------------------------------------------------


@query("source_jsonl_records", "select case doc_id % 6 when 0 then 'messages' when 1 then 'completion' when 2 then 'text' when 5 then null "
       "else 'instruction' end as shape, coalesce(case when doc_id % 6 = 2 then text when doc_id % 6 = 1 then source end, '') as given, "
       "count(*) as records from documents group by 1, 2")
def _jsonl(spark, sf_dir):
    path = fresh_path(spark, "records")
    raw_records(spark, sf_dir).select("record").write.text(path)
    # Spark names its parts *.txt; the folder reader is given the same lines as .jsonl
    lines = files.require_valid(files.read_jsonl(spark, path))
    out = textdata.normalize_instruction(lines)
    return out.groupBy("shape", F.coalesce("text", "prompt", F.lit("")).alias("given")).agg(F.count(F.lit(1)).alias("records"))


@query("text_normalised_set", """select 'records' as part, case doc_id % 6 when 0 then 'messages' when 1 then 'completion' when 2 then 'text' else 'instruction' end as kind,
  count(*) as "rows", 0::bigint as misplaced from documents where doc_id % 6 <> 5 group by 2
union all select 'rejects', 'no known shape', count(*), 0 from documents where doc_id % 6 = 5
union all select 'rejects', 'no JSON object', count(*), 0 from documents""")
def _normalised(spark, sf_dir):
    """The committed set and its rejects; every broken line is named by the file and line it stands on."""
    folder, base = fresh_path(spark, "records"), fresh_path(spark, "normalised")
    # each record is followed by a broken one that says how many lines of its part come before it
    lines = raw_records(spark, sf_dir).select(F.posexplode(F.array("record", F.lit("{broken"))).alias("k", "value")).select("value")
    lines.write.text(f"{folder}/part.jsonl")
    manifest = files.write_normalised(spark, f"{folder}", base)
    rejects = spark.read.parquet(manifest["paths"]["rejects"])
    records = files.read_latest(spark, base, "instruction_records")
    found = records.groupBy(F.lit("records").alias("part"), F.col("shape").alias("kind")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("line") % 2 != 1).alias("misplaced"))
    return found.unionByName(rejects.groupBy(F.lit("rejects").alias("part"), F.col("reason").alias("kind")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if((F.col("reason") == "no JSON object") & (F.col("line") % 2 != 0)).alias("misplaced")))


@query("source_graph_table", with_tx(
    "select count(*) as nodes, count(distinct node_id) as ids, 0e0 as absent from (select distinct 'ACCT_' || account_id_hash as node_id from tx) as q",
    "account_id_hash"))
def _graph_table(spark, sf_dir):
    """A node table from CSV with a feature column that the file does not have."""
    path = fresh_path(spark, "nodes")
    nodes = tx(spark, sf_dir).select(F.concat(F.lit("ACCT_"), "account_id_hash").alias("node_id")).distinct()
    nodes.write.option("header", True).csv(path)
    table = files.read_graph_table(spark, path, "csv", ["absent"])
    return table.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("node_id").alias("ids"), F.sum("absent").alias("absent"))


@query("source_json_documents", "select doc_id, lang, text from documents")
def _json_documents(spark, sf_dir):
    """Whole-file JSON: every line of a written folder is wrapped into one list per file and read back."""
    path = fresh_path(spark, "json-documents")
    docs = sample_view.table(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "lang", "text")).alias("record"))
    files_wanted = F.lit(max(1, docs.count() // 200))  # about 200 documents each, whatever the table
    listed = docs.withColumn("file", F.pmod(F.xxhash64("record"), files_wanted)).groupBy("file").agg(
        F.concat(F.lit('{"data":['), F.array_join(F.collect_list("record"), ","), F.lit("]}")).alias("value"))
    listed.write.partitionBy("file").text(path)
    rows = files.require_valid(files.read_json_documents(spark, path))
    return rows.select(*[F.get_json_object("record", f"$.{k}").cast(t).alias(k) for k, t in (("doc_id", "long"), ("lang", "string"), ("text", "string"))])


@query("source_transactions_csv", with_tx(
    f"select count(*) as \"rows\", sum(label_is_fraud)::bigint as frauds, {round_sql('avg(amount_inr)', 4)} as mean_amount, "
    "max(epoch_us(transaction_dt)) as latest from tx", "label_is_fraud", "amount_inr", "transaction_dt"))
def _csv(spark, sf_dir):
    path = fresh_path(spark, "csv")
    # files in gzip are read by one task each: none holds more rows than one task should
    tx(spark, sf_dir).write.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX").option(
        "compression", "gzip").option("maxRecordsPerFile", 500_000).csv(path)
    df = files.read_transactions(spark, path, "csv")
    return tidy(df.agg(F.count(F.lit(1)).alias("rows"), F.sum("label_is_fraud").alias("frauds"),
                       F.avg("amount_inr").alias("mean_amount"), F.max("transaction_dt").alias("latest")), 4)


@query("sink_versions_latest", with_tx(
    "select channel, count(*) as \"rows\" from tx group by 1", "channel"))
def _versions(spark, sf_dir):
    base = fresh_path(spark, "versions")
    df = tx(spark, sf_dir).select("transaction_id", "channel")
    files.write_version(df.withColumn("channel", F.lit("OLD")), base, "raw", "run1")
    files.write_version(df, base, "raw", "run2")
    return files.read_latest(spark, base, "raw").groupBy("channel").agg(F.count(F.lit(1)).alias("rows"))


@query("sink_versions_committed", with_tx("".join(
    f"{'union all ' if i else ''}select '{name}' as reader, count(*) as \"rows\", max({value}) as version from tx where {part} "
    for i, (name, value, part) in enumerate((("before", "1", "label_is_fraud = 1"), ("during", "1", "label_is_fraud = 1"),
                                             ("after", "3", "true"), ("second", "2", "label_is_fraud = 0")))), "label_is_fraud"))
def _committed(spark, sf_dir):
    """What readers of three commits see: data that is written but not committed does not count."""
    base = fresh_path(spark, "versions")
    df = materialize(tx(spark, sf_dir).select("transaction_id", "label_is_fraud"), "rows")
    files.write_version(df.where("label_is_fraud = 1").withColumn("version", F.lit(1)), base, "raw", "run1")
    seen = {"before": files.read_latest(spark, base, "raw")}
    df.limit(10).withColumn("version", F.lit(9)).write.parquet(f"{base}/raw/run_id=broken")  # a writer that has not come to its commit
    seen["during"] = files.read_latest(spark, base, "raw")
    files.write_version(df.where("label_is_fraud = 0").withColumn("version", F.lit(2)), base, "raw", "run2")
    files.write_version(df.withColumn("version", F.lit(3)), base, "raw", "run3")
    seen["after"] = files.read_latest(spark, base, "raw")
    seen["second"] = files.read_version(spark, base, "raw", "run2")
    parts = [d.agg(F.lit(k).alias("reader"), F.count(F.lit(1)).alias("rows"), F.max("version").alias("version")) for k, d in seen.items()]
    return tidy(parts[0].union(parts[1]).union(parts[2]).union(parts[3]))


@query("sink_keyed_store", """with batches as (
  select 0 as b, c_custkey as k, c_acctbal as v, 1000 + c_custkey % 7 * 100 as e from customer
  union all select 1, c_custkey, c_acctbal + 1, 1250 from customer where c_custkey % 2 = 0
  union all select 2, c_custkey, c_acctbal + 2, case when c_custkey % 5 = 0 then 900 else 2000 end from customer where c_custkey % 3 = 0),
newest as (select * from batches qualify row_number() over (partition by k order by b desc) = 1)
select 'score:' || k as key, round(v + 1e-10, 2) as value, e::bigint as expires from newest where e > 1200""")
def _keyed_store(spark, sf_dir):
    """Three overlapping batches, one of them handed over twice, with a compaction in between."""
    store = KeyedStore(spark, fresh_path(spark, "store"))
    customers = sample_view.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").cast("double").alias("v"))
    keyed = lambda df, e: df.select(F.concat(F.lit("score:"), "k").alias("key"), F.timestamp_seconds(e).alias("expires_at"),
                                    F.round(F.col("v") + 1e-10, 2).alias("value"))
    late = keyed(customers.where("k % 3 = 0").withColumn("v", F.col("v") + 2), F.when(F.col("k") % 5 == 0, 900).otherwise(2000))
    store.upsert(keyed(customers, 1000 + F.col("k") % 7 * 100), 0)
    store.upsert(late, 2)  # ahead of its turn
    store.compact(F.timestamp_seconds(F.lit(100)))
    store.upsert(keyed(customers.where("k % 2 = 0").withColumn("v", F.col("v") + 1), F.lit(1250)), 1)
    store.upsert(late.withColumn("value", F.lit(-1.0)), 2)  # again: changes nothing
    store.clean()
    return store.read(F.timestamp_seconds(F.lit(1200))).select("key", "value", F.unix_seconds("expires_at").alias("expires"))


@query("run_manifests", with_tx(
    f"select 'dataset' as run, 'all' as part, count(*) as \"rows\" from tx union all select 'injection', 'all', count(*) from tx "
    f"union all select 'training', split, count(*) from ({SPLIT_SQL}) as s group by 2 "
    f"union all select 'training_fraud', split, sum(label_is_fraud)::bigint from ({SPLIT_SQL}) as s group by 2", *SPLIT_NAMES))
def _manifests(spark, sf_dir):
    """Rows as the committed manifests of the dataset, injection and training runs report them."""
    base = fresh_path(spark, "runs")
    # the first step of the run stores the rows
    pipelines.hybrid(tx(spark, sf_dir), base, {"trees": 3, "depth": 3}, train_gnn=False, stored_scores=sample_view.account_scores(spark, sf_dir))
    data = files.read_manifest(spark, f"{base}/dataset", "dataset")
    injected, trained_run = files.read_manifest(spark, base, "injection"), files.read_manifest(spark, base, "training")
    rows = [("dataset", "all", data["row_count"])]
    rows.append(("injection", "all", spark.read.parquet(injected["output"]).count()))
    rows += [("training", k, n) for k, n in trained_run["rows"].items()] + [("training_fraud", k, n) for k, n in trained_run["fraud"].items()]
    return spark.createDataFrame(rows, "run string, part string, `rows` bigint")


# ---- dataset bundle ---------------------------------------------------------------------


@query("dataset_bundle", ORACLES["split_statistics"])
def _bundle(spark, sf_dir):
    # the first step of the build stores the rows
    manifest = pipelines.build_dataset(tx(spark, sf_dir), fresh_path(spark, "dataset"))
    return tidy(spark.createDataFrame([(s["split"], s["n_total"], s["n_fraud"], s["fraud_rate"]) for s in manifest["splits"]],
                                      "split string, n_total bigint, n_fraud bigint, fraud_rate double"))


# ---- trained models ---------------------------------------------------------------------

_MODELS: dict[tuple[str, str], tuple] = {}


def trained(spark, sf_dir):
    """(path of the saved tree model, its metrics, its scored rows, the stored transactions); trained
    with the library's defaults, once per session and folder."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _MODELS:
        df = materialize(tx(spark, sf_dir), "transactions")
        model, judged = pipelines.train_transactions(df)
        path = fresh_path(spark, "tree-model")
        model.save(path)
        _MODELS[at] = (path, materialize(judged, "metrics"), model.scored, df)
    return _MODELS[at]


_EDGE_COUNTS = "".join(
    f"\nunion all select '{name}', (select count(*) from (select distinct account_id_hash, {key} from g where {key} is not null) as {name})"
    for name, key in (("account_device_edges", "device_fingerprint_hash"), ("account_ip_edges", "ip_node_id"),
                      ("account_merchant_edges", "merchant_node_id")))


@query("stage_graph_tables", ORACLES["graph_counts"] + _EDGE_COUNTS)
def _graph_tables(spark, sf_dir):
    df = materialize(tx(spark, sf_dir).select(*GRAPH_NAMES), "transactions")
    manifest = pipelines.build_graph_tables(df, fresh_path(spark, "graph"))
    discard(df)
    return spark.createDataFrame(list(manifest["counts"].items()), "`table` string, `rows` bigint")


def _recomputed(scored):
    """Precision and recall at one half, straight from the stored scores."""
    hit = (F.col("probability") >= 0.5) & (F.col("label") == 1)
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_total"), F.sum(F.col("label").cast("bigint")).alias("n_fraud"),
        F.try_divide(F.count_if(hit), F.count_if(F.col("probability") >= 0.5)).alias("p"),
        F.try_divide(F.count_if(hit), F.count_if(F.col("label") == 1)).alias("r"),
        (F.min("probability") >= 0).alias("low"), (F.max("probability") <= 1).alias("high"))


def _close(a, b):
    return F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) < 1e-9


def _in_unit(*names):
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).between(0.0, 1.0)
    return out


@query("model_accounts", with_graph(f"""select split, count(*) as n_total, sum(node_label)::bigint as n_fraud, true as metrics_hold, true as reload_agrees
from (select node_label, case when i < greatest(1, floor(n * 0.8e0)) then 'train' when i < greatest(greatest(1, floor(n * 0.8e0)) + 1, floor(n * 0.9e0)) then 'val' else 'test' end as split
  from (select node_label, row_number() over (order by last_tx, node_id) - 1 as i, count(*) over () as n
    from (select a as node_id, max(transaction_dt) as last_tx, max(label_is_fraud) as node_label from
      (select account_id_hash as a, transaction_dt, label_is_fraud from g union all
       select beneficiary_id_hash, transaction_dt, label_is_fraud from g) as r group by 1) as v) as o) as q group by 1""",
    ["transaction_dt", "label_is_fraud", "beneficiary_id_hash"]))
def _accounts(spark, sf_dir):
    """Rows and frauds per split, metrics in range, and the same scores from the saved and reloaded model."""
    df = materialize(tx(spark, sf_dir).select(*GRAPH_NAMES), "transactions")
    manifest = pipelines.build_graph_tables(df, fresh_path(spark, "graph"))
    discard(df)
    tables = pipelines.graph_tables(spark, manifest)
    model, scores, judged = pipelines.train_accounts(tables)
    path = fresh_path(spark, "account-model")
    model.save(path)
    again = pipelines.score_accounts(models.AccountModel.load(path), tables)
    joined = scores.withColumnRenamed("gnn_fraud_probability", "a").join(
        again.select("account_id_hash", F.col("gnn_fraud_probability").alias("b")), "account_id_hash", "full")
    off = joined.where(~F.coalesce(F.abs(F.col("a") - F.col("b")) < 1e-9, F.lit(False))).count()
    rows = judged.withColumns({"n_total": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), "n_fraud": F.col("tp") + F.col("fn")})
    return rows.select("split", "n_total", "n_fraud", _in_unit("precision", "recall", "auc", "pr_auc", "ece").alias("metrics_hold"),
                       F.lit(off == 0).alias("reload_agrees"))


@query("model_network", ORACLES["model_accounts"])
def _network_training(spark, sf_dir):
    """The two-layer network, learned over the whole graph in a few epochs, saved, reloaded and applied again."""
    df = materialize(tx(spark, sf_dir).select(*GRAPH_NAMES), "transactions")
    manifest = pipelines.build_graph_tables(df, fresh_path(spark, "graph"))
    discard(df)
    tables = pipelines.graph_tables(spark, manifest)
    model, scores, judged = pipelines.train_network(tables, network.Training(hidden=8, epochs=3))
    path = fresh_path(spark, "network")
    model.save(path)
    again = pipelines.score_by_network(network.Network.load(path), tables)
    joined = scores.withColumnRenamed("gnn_fraud_probability", "a").join(
        again.select("account_id_hash", F.col("gnn_fraud_probability").alias("b")), "account_id_hash", "full")
    off = joined.where(~F.coalesce(F.abs(F.col("a") - F.col("b")) < 1e-9, F.lit(False))).count()
    rows = judged.withColumns({"n_total": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), "n_fraud": F.col("tp") + F.col("fn")})
    return rows.select("split", "n_total", "n_fraud", (_in_unit("precision", "recall", "auc", "pr_auc", "ece")
                                                       & F.lit(len(model.history) == 3)).alias("metrics_hold"), F.lit(off == 0).alias("reload_agrees"))


@query("model_transactions", with_tx(f"select split, count(*) as n_total, sum(label_is_fraud)::bigint as n_fraud, true as metrics_hold, "
       f"true as metrics_recomputed from ({SPLIT_SQL}) as s group by 1", *SPLIT_NAMES))
def _transactions(spark, sf_dir):
    """Rows and frauds per split; metrics lie in range and follow from the stored scores."""
    _, judged, scored, _ = trained(spark, sf_dir)
    both = _recomputed(scored).join(judged, "split")
    return both.select("split", "n_total", "n_fraud", (_in_unit("precision", "recall", "auc", "pr_auc", "ece", "raw_ece", "brier")
                                                       & F.col("low") & F.col("high")).alias("metrics_hold"),
                       (_close(F.col("p"), F.col("precision")) & _close(F.col("r"), F.col("recall"))).alias("metrics_recomputed"))


@query("model_calibration", with_tx("select count(*) as \"rows\", 0::bigint as falls from tx", "transaction_id"))
def _calibration(spark, sf_dir):
    """Calibrated scores never fall where raw scores rise: adjacent raw scores, by slices of the raw score."""
    _, _, scored, _ = trained(spark, sf_dir)
    points = scored.groupBy("raw_probability").agg(F.min("probability").alias("low"), F.max("probability").alias("high"), F.count(F.lit(1)).alias("n"))
    points = points.withColumn("slice", F.floor(F.col("raw_probability") * 1000))
    earlier = Window.partitionBy("slice").orderBy("raw_probability").rowsBetween(Window.unboundedPreceding, -1)
    inside = points.withColumn("before", F.max("high").over(earlier))
    slices = inside.groupBy("slice").agg(F.sum("n").alias("n"), F.count_if(F.col("low") < F.col("before") - 1e-12).alias("falls"),
                                         F.min("low").alias("low"), F.max("high").alias("high"))
    across = slices.withColumn("before", F.max("high").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))  # 1001 rows
    return across.agg(F.sum("n").alias("rows"), F.sum(F.col("falls") + F.coalesce(F.col("low") < F.col("before") - 1e-12, F.lit(False)).cast("int")).alias("falls"))


@query("model_feature_importance", f"select unnest([{', '.join(repr(f) for f in schema.FEATURES)}]) as feature, true as in_range, true as adds_up")
def _importance(spark, sf_dir):
    """Every feature has an importance in 0..1, and together they make one."""
    path = trained(spark, sf_dir)[0]
    rows = models.TreeModel.load(path).importance(spark)
    total = rows.agg(F.sum("importance").alias("t"))
    return rows.crossJoin(F.broadcast(total)).select("feature", F.col("importance").between(0.0, 1.0).alias("in_range"),
                                                     (F.abs(F.col("t") - 1) < 1e-9).alias("adds_up"))


@query("model_search", f"select unnest([{', '.join(repr(k) for k in models.SEARCH_SPACE)}]) as parameter, true as inside, true as best_wins")
def _search(spark, sf_dir):
    """Two draws from the whole space, fitted side by side with early stopping. The draw whose rows of val, scored
    again, have the higher average precision is the one that is kept."""
    table = materialize(pipelines.training_table(materialize(tx(spark, sf_dir), "transactions")), "training")
    best = models.train_trees(table, candidates=models.search_params(2), early_stop=True)
    winner = max(best.trials, key=lambda t: t["val_pr_auc"])
    again = materialize(best.score(table.where("split = 'val'"), ["label", "split"]).select(
        "label", "split", F.col("raw_probability").alias("probability")), "again")
    reached = metrics.rank_metrics(again, ["split"]).first()["pr_auc"]
    won = abs(reached - winner["val_pr_auc"]) < 1e-9 and len(best.trials) == 2
    rows = [(k, low <= best.params[k] <= high, won and best.params[k] == winner[k]) for k, (low, high) in models.SEARCH_SPACE.items()]
    return spark.createDataFrame(rows, "parameter string, inside boolean, best_wins boolean")


@query("model_scores_explained", with_tx("select transaction_id, true as adds_up, true as risk_follows, true as flag_follows, "
       "mule_network_probability from tx", "transaction_id", "mule_network_probability"))
def _explained(spark, sf_dir):
    """Bias and contributions add up to the margin of every row; risk and flag follow from the probability."""
    path, _, _, df = trained(spark, sf_dir)
    model = models.TreeModel.load(path)
    out = pipelines.score_and_explain(df, model, k=len(model.features))
    total = F.aggregate("top_contributors", F.col("model_bias"), lambda a, x: a + x["contribution"])
    chance = 1 / (1 + F.exp(-total))
    p = F.col("probability")
    return tidy(out.select(
        "transaction_id", (F.abs(chance - F.col("raw_model_probability")) < 1e-4).alias("adds_up"),
        (F.abs(F.col("risk_score") - p * 100) <= 0.5 + 1e-3).alias("risk_follows"),
        ((F.col("is_fraud") == (p >= 0.5)) | (F.abs(p - 0.5) < 1e-6)).alias("flag_follows"),
        F.col("gnn_findings.mule_network_probability").alias("mule_network_probability")))


@query("model_rows_kept", bad_rows("select count(*) as \"rows\", count(*) filter (transaction_id is null) as without_id, "
       "count(*) filter (transaction_id = 'dup') as repeated from bad"))
def _rows_kept(spark, sf_dir):
    """The training table has every row, also those without an id or with a repeated one."""
    table = pipelines.training_table(materialize(defective(spark, sf_dir), "transactions"))
    return table.agg(F.count("split").alias("rows"), F.count_if(F.col("transaction_id").isNull()).alias("without_id"),
                     F.count_if(F.col("transaction_id") == "dup").alias("repeated"))


@query("hybrid_run", f"select unnest([{', '.join(repr(m) for m, _, _ in schema.DEPLOYMENT_GATES)}]) as metric, true as follows, true as conjunction")
def _hybrid(spark, sf_dir):
    """Every gate is reported, follows from its value, and all of them make the verdict."""
    result = pipelines.hybrid(materialize(tx(spark, sf_dir), "transactions"), fresh_path(spark, "hybrid"))
    rows = materialize(result["gates"], "gates")
    follows = F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    verdict = rows.agg(F.min("passed").alias("every"))
    return rows.crossJoin(F.broadcast(verdict)).select(
        "metric", ((follows == F.col("passed")) | (F.abs(F.col("value") - F.col("threshold")) < 1e-6)).alias("follows"),
        (F.col("all_passed") == F.col("every")).alias("conjunction"))


# ---- streams ----------------------------------------------------------------------------


def _events(spark, sf_dir, delay="1 hour"):
    return streaming.event_time(streaming.stream_table(spark, f"{sf_dir}/events.parquet"), "ts", delay)


_CLOSED = "(select max(ts) - interval 1 hour from events)"


@query("stream_window_velocity", "select epoch_us(s) as window_start, epoch_us(s + interval 1 hour) as window_end, user_id, count(*) as n, "
       f"{round_sql('sum(value)', 4)} as total from (select user_id, value, time_bucket(interval 15 minutes, ts) - to_minutes(15 * k) as s "
       f"from events, (values (0), (1), (2), (3)) as o(k)) as q where s + interval 1 hour <= {_CLOSED} group by s, user_id")
def _stream_velocity(spark, sf_dir):
    out = streaming.window_velocity(_events(spark, sf_dir), "user_id", "ts", "value", "event_type", "1 hour", "15 minutes")
    result = streaming.run_available(out, "stream-velocity").drop("distinct_items")
    newest = sample_view.table(spark, sf_dir, "events").agg((F.max("ts").cast("timestamp") - F.expr("interval 1 hour")).alias("m")).first()[0]
    return tidy(streaming.closed_windows(result, F.lit(newest)), 4)


@query("stream_first_pairs", "select distinct user_id, event_type from events")
def _stream_first(spark, sf_dir):
    out = streaming.first_pairs(_events(spark, sf_dir, "60 days"), "user_id", "event_type").select("user_id", "event_type")
    return streaming.run_available(out, "stream-first")


@query("stream_after_silence", f"select event_id, {round_sql('gap', 3)} as silence_seconds from (select event_id, ts, "
       "(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1e6 as gap from events) as q where gap > 36000 "
       "and epoch_ms(ts) < (select epoch_ms(max(ts)) - 3600000 from events)")
def _stream_silence(spark, sf_dir):
    """Rows the watermark has passed; the newest hour is still open."""
    out = streaming.after_silence(_events(spark, sf_dir), "user_id", "ts", "event_id", 36000)
    return tidy(streaming.run_available(out, "stream-silence"), 3)


@query("stream_fan_out", "select c.user_id, c.event_id as credit_id, count(distinct p.event_type) as items from events c join events p "
       "on p.user_id = c.user_id and p.ts >= c.ts and p.ts <= c.ts + interval 12 hours where c.event_type = 'purchase' and p.event_type <> 'purchase' "
       "and epoch_ms(c.ts + interval 12 hours) < (select epoch_ms(max(ts)) - 3600000 from events) "
       "group by 1, 2 having count(distinct p.event_type) >= 2")
def _stream_fan_out(spark, sf_dir):
    """Credits whose window the watermark has passed."""
    out = streaming.dispersed_credits(_events(spark, sf_dir), "user_id", "ts", F.col("event_type") == "purchase", "event_id", "event_type",
                                      12 * 3600, 2)
    return streaming.run_available(out, "stream-fan-out")


@query("stream_scoring", with_tx("select count(*) as \"rows\", 0::bigint as differing from tx", "transaction_id"))
def _stream_scoring(spark, sf_dir):
    """The stored model over a stream, against the same reloaded model over the whole table."""
    saved, _, _, df = trained(spark, sf_dir)
    model = models.TreeModel.load(saved)
    path = fresh_path(spark, "stream-input")
    df.repartition(3).write.parquet(path)

    def score(batch):
        scored = model.score(features.transform(batch, ["transaction_id"]), ["transaction_id"])
        return explain.score_response(scored.drop("features")).select("transaction_id", "is_fraud", "risk_score", "probability")

    done = streaming.score_stream(streaming.stream_table(spark, path, max_files=1), score, "stream-scores")
    streamed, whole = spark.read.parquet(done), score(df)
    kinds = ["transaction_id", "is_fraud", "risk_score", "probability"]
    counted = streamed.groupBy(*kinds).agg(F.count(F.lit(1)).alias("n")).unionByName(
        whole.groupBy(*kinds).agg((-F.count(F.lit(1))).alias("n")))
    off = counted.groupBy(*kinds).agg(F.sum("n").alias("n")).agg(F.sum(F.abs("n")).alias("differing"))
    return streamed.agg(F.count(F.lit(1)).alias("rows")).crossJoin(F.broadcast(off))
