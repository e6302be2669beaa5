"""Files, stores, registries, and streams against their batch twins."""

from __future__ import annotations

import hashlib
from datetime import datetime
from inspect import signature

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from cloakframe.functions.times import moment
from cloakframe.operators import audit, registry
from cloakframe.plans.anonymize import anonymize, check_parameters, protect
from cloakframe.plans.optimize import Search, optimize
from cloakframe.sources import audit_log, files, tables
from cloakframe.sources import registry as registry_tables
from cloakframe.streaming import audit_streams
from cloakframe.streaming.protect import protect_stream


def test_csv_dialects(spark, tmp_path):
    for name, sep in (("a", ";"), ("b", "\t"), ("c", "|"), ("d", ",")):
        path = tmp_path / f"{name}.csv"
        path.write_text(sep.join(["id", "when", "note"]) + "\n" + "".join(f"{i}{sep}2024-01-0{i}{sep}N/A\n" for i in range(1, 4)))
        assert tables.sniff_csv(spark, str(path))[0] == sep
        df = tables.scan_csv(spark, str(path))
        assert dict(df.dtypes) == {"id": "bigint", "when": "timestamp_ntz", "note": "string"} and df.filter("note is not null").count() == 0


def test_latin1_is_detected(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes("id,name\n1,Jos\xe9\n".encode("latin-1"))
    assert tables.sniff_csv(spark, str(path)) == (",", "iso-8859-1")
    assert tables.scan_csv(spark, str(path)).first()["name"] == "José"


def test_a_late_line_decides_the_encoding(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_bytes(("id,name\n" + "".join(f"{i},x\n" for i in range(3000)) + "3000,Jos\xe9\n").encode("latin-1"))
    assert tables.scan_csv(spark, str(path)).where("id = 3000").first()["name"] == "José"


def test_csv_keeps_every_text(spark, tmp_path):
    texts = ["a\nb", 'say "hi", then; go', "  lead and trail  ", "tab\there|pipe", "\n\n", '"', "plain", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for sep in (",", ";"):
        tables.write_csv(df, str(tmp_path / sep.replace(";", "s")), sep)
        back = tables.scan_csv(spark, str(tmp_path / sep.replace(";", "s")), df.schema)
        got = {r["id"]: r["text"] for r in back.collect()}
        assert got == {i: None if t is None or not t.strip(" ") else t for i, t in enumerate(texts)}


def test_csv_counts_what_does_not_fit(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text("id,name\n1,a\n2,b,extra\n3,c\n")
    with pytest.warns(UserWarning, match="1 records"):
        assert sorted(r["id"] for r in tables.scan_csv(spark, str(path)).collect()) == [1, 3]
    records = tables.read_csv_records(spark, str(path))
    assert [r["_corrupt_record"] for r in records.collect() if r["_corrupt_record"]] == ["2,b,extra"]


def test_csv_dialect_is_decided_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,name\n1,Zoë\n".encode())
    (tmp_path / "b.csv").write_bytes("id;name\n2;José\n3;x,y\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes('id|name\n4|"two\nlines"\n5|"a ""q"""\r\n'.encode())
    got = {r["id"]: r["name"] for r in tables.scan_csv(spark, str(tmp_path)).collect()}
    assert got == {1: "Zoë", 2: "José", 3: "x,y", 4: "two\nlines", 5: 'a "q"'}


def test_split_quoted_records_equal_whole_files(spark, tmp_path):
    """Records over many small splits, with blank lines, escaped and stray quotes, equal the reader of whole files."""
    texts = ["plain", "", 'said "hi"', "a\n\nb", "\n", 'x"\n"y', 'long ' + "line\n" * 90, '5" pipe', "Zoë; x,y", '"', ',"\n",']
    lines = ["id,text,n", ""]
    for i in range(300):
        t = texts[i % len(texts)]
        lines.append(f'{i},{t if t == '5" pipe' else chr(34) + t.replace(chr(34), chr(34) * 2) + chr(34)},{i * 7}' + ("\n" if i % 13 == 0 else ""))
    (tmp_path / "q.csv").write_text("\n".join(lines) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    old, cost = spark.conf.get(key), spark.conf.get("spark.sql.files.openCostInBytes")
    whole = sorted(map(tuple, tables.read_csv_records(spark, str(tmp_path), assemble=False).collect()), key=str)
    spark.conf.set(key, "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        split = tables.read_csv_records(spark, str(tmp_path))
        assert "Scan text" in split._jdf.queryExecution().executedPlan().toString() and split.columns == ["id", "text", "n", "_corrupt_record"]
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        assert sorted(map(tuple, split.collect()), key=str) == whole and len(whole) == 300
    finally:
        spark.conf.set(key, old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_large_files_are_hashed_and_searched(spark, tmp_path):
    (tmp_path / "big.csv").write_text("x" * 500 + "<script>alert(1)</script>")
    row = files.file_manifest(spark, str(tmp_path), max_size=100).first()
    assert row["errors"] == "too_large" and row["suspicious"] and len(row["sha256"]) == 64 and not row["valid"]


def test_json_record_array(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": "y"}]')
    assert tables.scan_json(spark, str(path), record_array=True).count() == 2


def test_dataset_store_replaces_and_misses(spark, tmp_path):
    root = str(tmp_path)
    tables.save_dataset(spark.range(3), root, "x")
    tables.save_dataset(spark.range(5), root, "x")
    assert tables.load_dataset(spark, root, "x").count() == 5 and tables.load_dataset(spark, root, "y") is None


def test_file_manifest(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("a,b\n1,2\n")
    (tmp_path / "bad.csv").write_text("<SCRIPT>alert(1)</script>")
    (tmp_path / "tool.exe").write_text("x")
    rows = {r["name"]: r for r in files.file_manifest(spark, str(tmp_path)).collect()}
    assert rows["ok.csv"]["valid"] and rows["bad.csv"]["patterns"] == "<script" and not rows["bad.csv"]["valid"]
    assert rows["tool.exe"]["errors"] == "bad_extension"
    names = spark.createDataFrame([("a.pdf", 0), ("x?.csv", 5), ("", 3)], "name string, size long")
    found = {r["name"]: list(r["e"]) for r in names.select("name", files.name_errors(F.col("name"), F.col("size")).alias("e")).collect()}
    assert found == {"a.pdf": ["empty"], "x?.csv": ["bad_characters"], "": ["no_name", "bad_extension"]}
    large = {r["name"]: r for r in files.file_manifest(spark, str(tmp_path), max_size=5).collect()}
    content = (tmp_path / "bad.csv").read_bytes()
    # a file over the limit is not valid, and still hashed and searched whole
    assert large["ok.csv"]["errors"] == "too_large" and large["ok.csv"]["sha256"] == hashlib.sha256(b"a,b\n1,2\n").hexdigest()
    assert "too_large" in large["bad.csv"]["errors"] and large["bad.csv"]["patterns"] == "<script" and large["bad.csv"]["sha256"] == hashlib.sha256(content).hexdigest()


def test_manifest_in_blocks(spark, tmp_path):
    """Empty files are listed, patterns across blocks found, digests those of whole files."""
    (tmp_path / "sub").mkdir()
    texts = {"empty.csv": b"", "cut.csv": b"x" * 29 + b"<ScRiPt" + b"y" * 50, "sub/deep.csv": bytes(range(256)) * 5, "exact.csv": b"z" * 64}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    rows = {r["name"]: r for r in files.file_manifest(spark, str(tmp_path), block=32).collect()}
    assert {n.split("/")[-1] for n in texts} == set(rows)
    for name, text in texts.items():
        row = rows[name.split("/")[-1]]
        assert row["size"] == len(text) and row["sha256"] == hashlib.sha256(text).hexdigest()
    assert rows["cut.csv"]["patterns"] == "<script" and rows["empty.csv"]["errors"] == "empty" and rows["exact.csv"]["valid"]
    (tmp_path / "none").mkdir()
    assert files.file_manifest(spark, str(tmp_path / "none")).count() == 0


def test_manifest_of_a_file_over_two_gigabytes(spark, tmp_path):
    path = tmp_path / "huge.csv"
    with path.open("wb") as f:
        f.truncate(2**31 + 10)  # sparse
        f.seek(2**31)
        f.write(b"<script")
    row = files.file_manifest(spark, str(tmp_path)).first()
    with path.open("rb") as f:
        assert row["sha256"] == hashlib.file_digest(f, "sha256").hexdigest()
    assert row["size"] == 2**31 + 10 and row["patterns"] == "<script" and row["errors"] == "too_large"


def test_load_gate_on_empty_table(spark):
    rows = tables.load_gate(spark.createDataFrame([], "a int")).collect()
    assert [(r["severity"], r["check"]) for r in rows] == [("error", "no_rows")]


def _events(spark, n=400):
    k = F.col("id")
    return spark.range(n).select(
        k.cast("string").alias("id"), (moment(datetime(2024, 1, 1)) + F.make_dt_interval(F.lit(0), k.cast("int"))).alias("timestamp"),
        F.when(k % 5 != 0, F.concat(F.lit("u"), k % 7)).alias("user_id"), F.concat(F.lit("s"), k % 3).alias("session_id"),
        F.when(k % 2 == 0, "login").otherwise("privacy_noise").alias("action"), F.lit("r").alias("resource"),
        F.concat(F.lit("10.0.0."), F.when(k < 22, 1).otherwise(k % 40 + 2)).alias("ip_address"), (k % 2 == 1).alias("success"), (k % 10).cast("double").alias("execution_time"),
        F.when(k % 2 == 1, k / 100.0).alias("epsilon"), F.when(k % 2 == 1, F.lit(1e-6)).alias("delta"), F.lit("laplace").alias("mechanism"),
    )


def test_audit_log_round_trip_prunes_days(spark, tmp_path):
    root = str(tmp_path / "log")
    audit_log.append_audit_log(_events(spark), root)
    audit_log.append_audit_log(_events(spark, 10), root)
    logs = audit_log.read_audit_log(spark, root)
    assert logs.count() == 410
    day = audit.in_range(logs, datetime(2024, 1, 3), datetime(2024, 1, 4))
    assert "PartitionFilters: [isnotnull(date" in day._jdf.queryExecution().executedPlan().toString()
    target = str(tmp_path / "kept")
    audit_log.rewrite_retained(spark, root, target, datetime(2024, 1, 17), 7)
    assert audit_log.read_audit_log(spark, target).agg(F.min("timestamp")).first()[0] > datetime(2024, 1, 10)


def test_retention_bounds_and_periods(spark):
    with pytest.raises(ValueError):
        audit.retention_cleanup(_events(spark), datetime(2024, 1, 1), 3)
    with pytest.raises(ValueError):
        audit.check_period(datetime(2024, 1, 2), datetime(2024, 1, 1))


def test_only_more_than_ten_failures_are_suspicious(spark):
    rows = {r["ip_address"]: r for r in audit.security_events(_events(spark)).collect()}
    assert rows["10.0.0.1"]["failures"] == 11 and rows["10.0.0.1"]["suspicious"]
    assert not any(r["suspicious"] for ip, r in rows.items() if r["failures"] <= 10)


def test_scratch_tables_can_be_released(spark):
    from cloakframe.session import materialize, release_scratch

    kept = materialize(spark.range(5))
    assert kept.count() == 5 and release_scratch(spark) >= 1 and release_scratch(spark) == 0


def test_registry_round_trip(spark, tmp_path):
    budgets = spark.range(3).select(F.col("id").cast("int"), F.lit("s").alias("session_id"), F.lit(10.0).alias("total_epsilon"))
    registry_tables.write_table(budgets, str(tmp_path), "privacy_budgets")
    back = registry_tables.read_table(spark, str(tmp_path), "privacy_budgets")
    assert back.count() == 3 and "is_active" in back.columns


def test_protection_chart_without_assessments(spark):
    none = spark.createDataFrame([], "result_id long, linkage_attack_score double, membership_inference_score double, attribute_inference_score double")
    results = spark.createDataFrame([], "id long, status string")
    assert tuple(registry.risk_protection_chart(none, results).first()) == (95.0, 90.0, 88.0)


def test_streams_in_several_batches_equal_the_batch_result(spark, tmp_path):
    folder = str(tmp_path / "in")
    _events(spark).repartition(4).write.parquet(folder)
    batch = spark.read.parquet(folder)
    stream = audit_streams.read_events(spark, folder, "*.parquet", batch.schema, files_per_trigger=1)
    total = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    got = audit_streams.run_updates(audit_streams.budget_by_session(stream), ["session_id"])
    assert total(got) == total(audit_streams.budget_by_session(batch))
    got = audit_streams.run_updates(audit_streams.failed_by_ip(stream), ["ip_address"])
    assert total(got) == total(audit_streams.failed_by_ip(batch))
    got = audit_streams.run_updates(audit_streams.daily_activity(stream, "60 days"), ["day", "action"])
    assert total(got) == total(audit_streams.daily_activity(batch))


def test_protected_stream_equals_protected_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    _events(spark, 100).repartition(2).write.parquet(folder)
    batch = spark.read.parquet(folder)
    options = dict(key=["id"], salt="s", epsilon=1.0, identifiers=["user_id"], bounds={"execution_time": (0.0, 9.0)}, domains={"action": ["login", "privacy_noise"]})
    keep = ["id", "user_id", "action", "execution_time"]
    stream = audit_streams.read_events(spark, folder, "*.parquet", batch.schema)
    got = audit_streams.run_append(protect_stream(stream, **options).select(*keep)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, protect_stream(batch, **options).select(*keep).collect()), key=str)


@pytest.mark.parametrize("method", ["sdg", "dp", "sdc", "sdg_dp", "sdg_sdc", "dp_sdc", "full"])
def test_every_method_protects(spark, method):
    df = spark.range(200).select("id", (F.col("id") * 1.5).alias("pay"), (F.col("id") % 4).cast("string").alias("zone"))
    out = protect(df, method, "id", "s", 0.9, 1e-5, ["zone"], ["pay"])
    assert out.columns == df.columns and 0 < out.count() <= 200


def test_bad_parameters():
    for args in ((0, 1e-5, "dp"), (1, 0, "dp"), (1, 1, "dp"), (1, 1e-5, "other")):
        with pytest.raises(ValueError):
            check_parameters(*args)
    assert len(check_parameters(11, 1e-2, "dp")) == 2


def test_anonymize_measures_everything(spark):
    df = spark.range(150).select("id", (F.col("id") * 1.5).alias("pay"), (F.col("id") % 4).cast("string").alias("zone"))
    out = anonymize(df, "dp_sdc", "id", "s", 0.9, 1e-5, ["zone"], ["pay"], trees=5)
    assert {r["attack_type"] for r in out.attacks.collect()} == {"linkage", "membership", "attribute"}
    assert 0 <= out.utility.first()["overall_utility_score"] <= 1 and 0 <= out.privacy.first()["re_identification_risk"] <= 1


def test_search_keeps_the_smallest_objective(spark):
    df = spark.range(80).select("id", (F.col("id") * 1.5).alias("pay"), (F.col("id") % 4).cast("string").alias("zone"))
    found = optimize(df, "dp", "id", "s", max_iterations=2, attacks=["linkage"])
    rows = found.history.collect()
    assert len(rows) == 2 and found.best["epsilon"] == min(rows, key=lambda r: r["objective_score"])["parameters"]["epsilon"]


def test_registered_plans_run_every_attack(spark, monkeypatch):
    every = {"linkage", "membership", "attribute"}
    found = {r["metric"]: r["value"] for r in queries()["anonymize"](spark, "/root/testdata/sf0.001").where("section = 'attacks'").collect()}
    assert every | {"overall_risk_score"} == set(found) and all(v is not None for v in found.values())
    asked = []

    def recorded(*args, **options):
        call = signature(optimize).bind(*args, **options)
        call.apply_defaults()
        asked.append(set(call.arguments["attacks"]))
        return Search({}, spark.createDataFrame([(0, {"epsilon": 1.0}, 0.5)], "iteration int, parameters map<string,double>, privacy_score double"), [])

    monkeypatch.setattr("cloakframe.catalog.search.run_search", recorded)
    assert queries()["optimize"](spark, "/root/testdata/sf0.001").count() == 1
    assert asked == [every]


def test_trials_run_side_by_side_and_stay_in_order(spark, monkeypatch):
    import threading
    from types import SimpleNamespace

    from cloakframe.plans import optimize as plan

    met = threading.Barrier(3, timeout=20)

    def trial(df, method, key, salt, epsilon, *args, **options):
        met.wait()  # three trials have to be under way at once
        one = lambda **v: SimpleNamespace(first=lambda: v)
        return SimpleNamespace(privacy=one(re_identification_risk=epsilon / 20), attacks=SimpleNamespace(collect=list), overall=one(overall_risk_score=epsilon / 20),
                               utility=SimpleNamespace(first=lambda: [0.5]))

    monkeypatch.setattr(plan, "anonymize", trial)
    monkeypatch.setattr(plan, "TRIALS_AT_ONCE", 3)
    found = plan.optimize(spark.range(3), "dp", "id", "s", level="low", max_iterations=6)
    rows = sorted(found.history.collect(), key=lambda r: r["iteration"])
    assert [(r["iteration"], r["parameters"]["epsilon"], r["privacy_score"]) for r in rows] == [(i, e, e / 20) for i, e in enumerate([5.0] * 3 + [7.0] * 3)]
    assert found.best == {"epsilon": 5.0, "delta": 1e-5} and not found.failures
