"""End-to-end runs. Every stage writes its table; the next one reads the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema
from ..operators import explain, features, graph, inject, metrics, positions, propagate, quality
from ..operators.skew import heavy_keys
from ..session import fresh_path, materialize
from ..sources import files
from . import models, network


def build_dataset(tx: DataFrame, base: str, mode: str = "synthetic", scores: DataFrame | None = None,
                  temporal: bool = True, engineered: bool = True, splits: bool = True) -> dict:
    """Graph mode, quality report, raw table, engineered table, split table, manifest."""
    spark, run = tx.sparkSession, files.new_run_id()
    raw_path = files.write_version(features.apply_graph_mode(tx, mode, scores), base, "raw", run)
    raw = spark.read.parquet(raw_path)
    report = quality.validate(raw)
    counts = raw.agg(F.count(F.lit(1)).alias("n"), F.sum("label_is_fraud").alias("f")).first()
    payload = {"row_count": counts["n"], "fraud_count": counts["f"], "raw_path": raw_path, "graph_mode": mode,
               "schema_columns": schema.transaction_columns(), "quality": report.__dict__,
               "passes_contract": report.passes_contract}
    if engineered:
        payload["engineered_path"] = files.write_version(features.engineered_table(raw), base, "engineered", run)
    if splits:
        marked = (positions.temporal_split if temporal else positions.stratified_split)(raw)
        path = f"{base}/splits/run_id={run}"
        marked.write.partitionBy("split").option("compression", "zstd").parquet(path)
        payload["split_path"] = path
        payload["splits"] = [r.asDict() for r in positions.split_statistics(spark.read.parquet(path)).collect()]
    return files.write_manifest(spark, base, "dataset", run, payload)


def build_graph_tables(tx: DataFrame, base: str, max_edges: int | None = None, length: int | None = None) -> dict:
    """Nine graph tables with their row counts."""
    spark, run = tx.sparkSession, files.new_run_id()
    paths, counts = {}, {"transactions": tx.count()}
    stored = {}
    tx = graph.with_graph_ids(tx, counts["transactions"])
    for name, make in (("account_nodes", graph.account_nodes), ("device_nodes", graph.device_nodes),
                       ("ip_nodes", graph.ip_nodes), ("merchant_nodes", graph.merchant_nodes),
                       ("account_account_edges", graph.transfer_edges), ("account_device_edges", graph.device_edges),
                       ("account_ip_edges", graph.ip_edges), ("account_merchant_edges", graph.merchant_edges)):
        paths[name] = files.write_version(make(tx), base, name, run)
        stored[name] = spark.read.parquet(paths[name])
    derived = graph.shared_entity_edges(stored["account_device_edges"], stored["account_ip_edges"],
                                        stored["account_merchant_edges"], max_edges, length)
    paths["derived_account_edges"] = files.write_version(derived, base, "derived_account_edges", run)
    for name, path in paths.items():
        counts[name] = spark.read.parquet(path).count()  # answered from the file footers
    return files.write_manifest(spark, base, "graph", run, {"counts": counts, "files": paths})


def graph_tables(spark: SparkSession, manifest: dict) -> dict[str, DataFrame]:
    return {k: spark.read.parquet(v) for k, v in manifest["files"].items()}


def hop_table(tables: dict[str, DataFrame], base: list[str], statistics: DataFrame, hops: int, with_derived: bool) -> DataFrame:
    """Scaled node features and their neighbour means over 1..hops; each hop is stored, as the next reads it."""
    nodes = tables["account_nodes"]
    derived = tables["derived_account_edges"] if with_derived else None
    edges = materialize(propagate.message_edges(nodes, tables["account_account_edges"], derived), "messages")
    busy = materialize(heavy_keys(edges, ["src_node_id"]), "busy")
    table = materialize(propagate.standardize(nodes, statistics, base), "vectors")
    current = list(base)
    for hop in range(1, hops + 1):
        means = propagate.neighbour_mean(edges, table.select("node_id", *current), current, heavy=busy)
        fresh = means.select("node_id", *[F.col(f"n_{c}").alias(f"hop{hop}_{b}") for c, b in zip(current, base)])
        table = materialize(table.join(fresh, "node_id"), f"hop{hop}")
        current = [f"hop{hop}_{c}" for c in base]
    return table


def train_accounts(tables: dict[str, DataFrame], hops: int = 2, with_derived: bool = True,
                   exclude_label_features: bool = False) -> tuple[models.AccountModel, DataFrame, DataFrame]:
    """(model, scores of all accounts, metrics per split)."""
    base = [c for c in schema.ACCOUNT_FEATURES if not (exclude_label_features and c == "prior_confirmed_fraud")]
    nodes = tables["account_nodes"]
    statistics = materialize(propagate.feature_statistics(nodes, base), "scaler")
    table = hop_table(tables, base, statistics, hops, with_derived)
    marked = materialize(positions.account_temporal_split(nodes).select("node_id", "node_label", "split"), "split")
    model = models.train_account_model(marked, table, base, statistics, hops)
    model.with_derived = with_derived
    scored = materialize(model.score(table), "account-scores")
    judged = marked.join(scored, "node_id").select("split", F.col("node_label").alias("label"), "probability")
    return model, propagate.score_table(scored), metrics.evaluate(judged, ["split"])


def _network_inputs(tables: dict[str, DataFrame], base: list[str], with_derived: bool, statistics: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = tables["account_nodes"]
    vectors = materialize(propagate.standardize(nodes, statistics, base), "vectors")
    return vectors, propagate.message_edges(nodes, tables["account_account_edges"], tables["derived_account_edges"] if with_derived else None)


def train_network(tables: dict[str, DataFrame], settings: network.Training = network.Training(), with_derived: bool = True,
                  features: list[str] | None = None) -> tuple[network.Network, DataFrame, DataFrame]:
    """(two-layer network learned over the whole graph, scores of all accounts, metrics per split)."""
    base = list(features or schema.ACCOUNT_FEATURES)
    statistics = materialize(propagate.feature_statistics(tables["account_nodes"], base), "scaler")
    vectors, edges = _network_inputs(tables, base, with_derived, statistics)
    marked = positions.account_temporal_split(tables["account_nodes"]).select("node_id", F.col("node_label").alias("label"), "split")
    model, scored = network.train(network.prepare(vectors, edges, marked, base), settings)
    model.scaler, model.with_derived = statistics.first().asDict(), with_derived  # one row
    judged = scored.withColumn("label", F.col("label").cast("int")).select("split", "label", "probability")
    return model, propagate.score_table(scored), metrics.evaluate(judged, ["split"])


def score_by_network(model: network.Network, tables: dict[str, DataFrame]) -> DataFrame:
    """Scores of the accounts of any graph by a trained or reloaded network, with its own scaler."""
    scaler = tables["account_nodes"].sparkSession.createDataFrame([tuple(model.scaler.values())], ", ".join(f"`{c}` double" for c in model.scaler))
    vectors, edges = _network_inputs(tables, model.features, model.with_derived, scaler)
    return propagate.score_table(model.score(vectors, edges))


def score_accounts(model: models.AccountModel, tables: dict[str, DataFrame]) -> DataFrame:
    """Scores of the accounts of any graph by a trained or reloaded model, with the model's own scaler."""
    table = hop_table(tables, model.base, model.statistics, model.hops, model.with_derived)
    return propagate.score_table(materialize(model.score(table), "account-scores"))


def training_table(tx: DataFrame, temporal: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """transaction_id, features, label, weight, split and the kept columns: everything on one row.

    The split is an expression of the row, so nothing is joined on the id: rows without an id, or
    with a repeated one, stay as they are.
    """
    marked = (positions.temporal_split if temporal else positions.stratified_split)(features.sample_weights(tx))
    rows = features.transform(marked.withColumn("label", F.col("label_is_fraud").cast("double")),
                              ["transaction_id", "label", "sample_weight", "split", *keep])
    return rows.withColumnRenamed("sample_weight", "weight")


def train_transactions(tx: DataFrame, params: dict | None = None, candidates: list[dict] | None = None,
                       temporal: bool = True, early_stop: bool = False) -> tuple[models.TreeModel, DataFrame]:
    """(model, metrics per split, with the calibration error of the raw scores beside)."""
    table = materialize(training_table(tx, temporal), "training")
    model = models.train_trees(table, params=params, candidates=candidates, early_stop=early_stop)
    scored = materialize(model.score(table, ["transaction_id", "label", "split"]).drop("features"), "scored")
    model.scored = scored
    raw = metrics.calibration_error(scored.withColumn("probability", F.col("raw_probability")), ["split"])
    judged = metrics.evaluate(scored, ["split"]).join(raw.withColumnRenamed("ece", "raw_ece"), "split")
    return model, judged


def score_and_explain(tx: DataFrame, model: models.TreeModel, k: int = 10) -> DataFrame:
    """Published score columns, graph findings and ranked contributions per transaction; one row
    per row of `tx`, carried through without a join."""
    with_findings = tx.withColumn("gnn_findings", features.graph_findings(tx))
    table = features.transform(with_findings, ["transaction_id", "gnn_findings"])
    scored = materialize(model.score(table, ["transaction_id", "gnn_findings"]), "scores")
    shares = models.tree_contributions(scored, model, ["transaction_id", "gnn_findings", "raw_probability", "probability"])
    names = F.array(*[F.lit(f) for f in model.features])
    items = F.transform(F.arrays_zip(names.alias("f"), F.col("inputs").alias("v"), F.col("amounts").alias("c")), lambda x: F.struct(
        x["f"].alias("feature"), x["v"].alias("value"), x["c"].alias("contribution")))
    rows = materialize(shares.select("transaction_id", "gnn_findings", "raw_probability", "probability", "bias",
                                     items.alias("contributions")), "items")
    ranked = explain.rank_contributions(explain.describe_contributions(rows), k)
    return explain.score_response(ranked).withColumn("basis", F.lit(explain.BASIS)).withColumn(
        "model_bias", F.round("bias", 6)).drop("bias")


def training_manifest(spark: SparkSession, base: str, name: str, run: str, model, judged: DataFrame, **paths: str) -> dict:
    """Commit what a training run used and reached: parameters, history, metrics and rows per split, paths."""
    rows = {r["split"]: r.asDict() for r in judged.collect()}  # one row per split
    about = {"params": getattr(model, "params", None) or getattr(model, "settings", None), "trials": getattr(model, "trials", []),
             "history": getattr(model, "history", None) or getattr(model, "losses", []), "features": getattr(model, "features", None),
             "metrics": rows, "artifacts": paths,
             "rows": {k: v["tp"] + v["fp"] + v["fn"] + v["tn"] for k, v in rows.items()},
             "fraud": {k: v["tp"] + v["fn"] for k, v in rows.items()}}
    return files.write_manifest(spark, base, name, run, about)


def hybrid(tx: DataFrame, base: str, params: dict | None = None, train_gnn: bool = True, train_trees: bool = True,
           stored_scores: DataFrame | None = None) -> dict:
    """Transactions, graph, account model, scores, enriched transactions, boosted trees."""
    spark = tx.sparkSession
    result = {"dataset": build_dataset(tx, f"{base}/dataset", engineered=False, splits=False)}
    raw = spark.read.parquet(result["dataset"]["raw_path"])
    result["graph"] = build_graph_tables(raw, f"{base}/graph")
    run = files.new_run_id()
    if train_gnn:
        accounts, scores, result["account_metrics"] = train_accounts(graph_tables(spark, result["graph"]))
        accounts.save(f"{base}/account_model/run_id={run}")
        result["account_training"] = training_manifest(spark, base, "account_training", run, accounts, result["account_metrics"],
                                                       model_path=f"{base}/account_model/run_id={run}")
    elif stored_scores is not None:
        scores = stored_scores
    else:
        raise ValueError("without training, stored account scores are needed")
    scores_path = files.write_version(scores, base, "account_scores", run)
    scores = spark.read.parquet(scores_path)
    result["scores"] = propagate.score_summary(scores)
    enriched_path = files.write_version(inject.inject_scores(raw, scores, keep_probability=True), base, "enriched", run)
    enriched = spark.read.parquet(enriched_path)
    result["injection"] = inject.injection_summary(enriched)
    result["injection_manifest"] = files.write_manifest(spark, base, "injection", run, {
        "input": result["dataset"]["raw_path"], "scores": scores_path, "output": enriched_path,
        "summary": result["injection"].first().asDict()})  # one row
    if train_trees:
        result["model"], result["metrics"] = train_transactions(enriched, params)
        result["model"].save(f"{base}/tree_model/run_id={run}")
        result["training"] = training_manifest(spark, base, "training", run, result["model"], result["metrics"],
                                               model_path=f"{base}/tree_model/run_id={run}", data=enriched_path)
        result["gates"] = metrics.gates(result["metrics"].where("split = 'test'"))
    return result
