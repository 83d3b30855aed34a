"""Scoring rules at every threshold, golden payload, validation, and stream = batch."""

from __future__ import annotations

from churnlens.operators import scoring
from churnlens.session import scratch_path
from churnlens.streaming import scoring_stream
from helpers import make_requests

GOLDEN = dict(tenure=12, voice_usage=200.5, data_usage=5.2, complaints=1, contract_type="postpaid",
              monthly_charges=65.0, internet_service="Fiber optic", online_security="No",
              tech_support="Yes", streaming_tv="No")


def _score(spark, rows):
    return {r.customerID: r for r in scoring.score(scoring.valid_requests(make_requests(spark, rows))).collect()}


def test_golden_payload(spark):
    r = _score(spark, [GOLDEN])["R0000"]
    assert (r.score, r.probability, r.risk_level) == (40, 0.4, "Moyen")
    assert r.recommendations == ["Contacter le client pour résoudre les problèmes signalés"]
    assert {k: v.impact for k, v in r.factor_map.items()} == {
        "tenure": "low", "complaints": "medium", "contract": "low", "internet": "medium"}
    assert [f.factor for f in r.factors] == ["tenure", "complaints", "contract", "internet"]


def test_thresholds(spark):
    rows = [{"tenure": t} for t in (5, 6, 11, 12, 23, 24)]
    rows += [{"complaints": c} for c in (0, 1, 2, 3)]
    rows += [{"monthly_charges": m} for m in (80.0, 80.01)]
    rows += [{"data_usage": d} for d in (1.99, 2.0)]
    rows += [{"contract_type": "PrePaid"}]
    got = _score(spark, rows)
    pts = [got[f"R{i:04d}"].raw_score for i in range(len(rows))]
    base = 5  # postpaid only
    assert pts[:6] == [base + 30, base + 20, base + 20, base + 10, base + 10, base]
    assert pts[6:10] == [base, base + 15, base + 15, base + 25]
    assert pts[10:12] == [base, base + 10]
    assert pts[12:14] == [base + 15, base]
    assert pts[14] == 20
    assert got["R0014"].factor_map["contract"].value == "PrePaid"


def test_levels_cap_and_fallback(spark):
    rows = [
        # 10 + 15 + 5 + 10 = 40 -> Moyen; 39 impossible with these weights, check 35 -> Faible
        dict(tenure=20, complaints=1, internet_service="Fiber optic"),
        dict(tenure=20, complaints=0, data_usage=1.0),                 # 10+5+15 = 30
        dict(tenure=1, complaints=5, contract_type="prepaid", monthly_charges=99.0, data_usage=0.5,
             internet_service="Fiber optic", online_security="No", tech_support="No"),  # 120 -> 100
        dict(tenure=30),                                               # 5: fallbacks
        dict(tenure=8, complaints=3, contract_type="prepaid"),         # 20+25+20 = 65
        dict(tenure=8, complaints=3, contract_type="prepaid", data_usage=1.0),  # 80 -> Élevé
    ]
    got = _score(spark, rows)
    assert (got["R0000"].score, got["R0000"].risk_level) == (40, "Moyen")
    assert (got["R0001"].score, got["R0001"].risk_level) == (30, "Faible")
    assert (got["R0002"].raw_score, got["R0002"].score, got["R0002"].probability) == (120, 100, 1.0)
    assert got["R0003"].score == 5 and got["R0003"].recommendations == [
        "Maintenir la relation client avec des communications régulières",
        "Proposer le programme de fidélité"]
    assert (got["R0004"].score, got["R0004"].risk_level) == (65, "Moyen")
    assert (got["R0005"].score, got["R0005"].risk_level) == (80, "Élevé")
    assert len(got["R0002"].recommendations) == 6


def test_optional_fields_default(spark):
    r = _score(spark, [dict(monthly_charges=None, internet_service=None, online_security=None,
                            tech_support=None, streaming_tv=None)])["R0000"]
    # defaults: 50.0 (no charge factor), Fiber optic (+10), No/No (+10)
    assert r.raw_score == 5 + 10 + 10
    assert set(r.factor_map) == {"tenure", "complaints", "contract", "internet", "services"}


def test_validation(spark):
    rows = [dict(voice_usage=0.0), dict(voice_usage=-1.0), dict(data_usage=0.0),
            dict(complaints=-1), dict(tenure=None), dict(contract_type=None), dict()]
    req = make_requests(spark, rows)
    rej = {r.customerID: r.reason for r in scoring.rejected_requests(req).collect()}
    assert rej == {"R0000": "voice_usage: must be > 0", "R0001": "voice_usage: must be > 0",
                   "R0002": "data_usage: must be > 0", "R0003": "complaints: must be >= 0",
                   "R0004": "tenure: missing", "R0005": "contract_type: missing"}
    assert [r.customerID for r in scoring.valid_requests(req).collect()] == ["R0006"]


def test_stream_equals_batch(spark):
    rows = [dict(tenure=t, complaints=t % 4, data_usage=1.0 + t % 3) for t in range(40)]
    rows.append(dict(voice_usage=0.0))
    req = make_requests(spark, rows)
    root = scratch_path(spark, "test-stream")
    # two files arrive: the second batch must be scored too
    req.limit(20).write.parquet(f"{root}/in")
    req.subtract(req.limit(20)).write.mode("append").parquet(f"{root}/in")
    q = scoring_stream.start_scoring_stream(spark, f"{root}/in", f"{root}/out", f"{root}/ck")
    q.awaitTermination()
    cols = ["customerID", "raw_score", "score", "probability", "risk_level"]
    streamed = sorted(tuple(r) for r in scoring_stream.read_scored(spark, f"{root}/out").select(*cols).collect())
    batch = sorted(tuple(r) for r in scoring.score(scoring.valid_requests(req)).select(*cols).collect())
    assert streamed == batch and len(batch) == 40
    rejected = scoring_stream.read_rejected(spark, f"{root}/out").collect()
    assert [(r.customerID, r.reason) for r in rejected] == [("R0040", "voice_usage: must be > 0")]


def test_stream_json_source_small_batches(spark):
    rows = [dict(tenure=t, complaints=t % 4) for t in range(12)]
    req = make_requests(spark, rows)
    root = scratch_path(spark, "test-stream-json")
    for i in range(3):
        req.where(f"tenure % 3 = {i}").coalesce(1).write.mode("append").json(f"{root}/in")
    q = scoring_stream.start_scoring_stream(spark, f"{root}/in", f"{root}/out", f"{root}/ck",
                                            source_format="json", max_files_per_trigger=1)
    q.awaitTermination()
    batches = scoring_stream.live_entries(spark, f"{root}/out")
    assert [b.first_batch for b in batches] == [b.last_batch for b in batches] == [0, 1, 2]  # one file per micro-batch
    cols = ["customerID", "score", "risk_level"]
    streamed = sorted(tuple(r) for r in scoring_stream.read_scored(spark, f"{root}/out").select(*cols).collect())
    batch = sorted(tuple(r) for r in scoring.score(scoring.valid_requests(req)).select(*cols).collect())
    assert streamed == batch


def test_stream_restart_does_not_duplicate(spark):
    req = make_requests(spark, [dict(tenure=t) for t in range(10)])
    root = scratch_path(spark, "test-stream-restart")
    req.write.parquet(f"{root}/in")
    for _ in range(2):  # second run: same checkpoint, nothing new to score
        scoring_stream.start_scoring_stream(spark, f"{root}/in", f"{root}/out", f"{root}/ck").awaitTermination()
    assert scoring_stream.read_scored(spark, f"{root}/out").count() == 10
    req.limit(3).write.mode("append").parquet(f"{root}/in")  # new file: only it is scored
    scoring_stream.start_scoring_stream(spark, f"{root}/in", f"{root}/out", f"{root}/ck").awaitTermination()
    assert scoring_stream.read_scored(spark, f"{root}/out").count() == 13


def test_score_file_json(spark):
    import json
    import os
    from churnlens.plans import jobs
    root = scratch_path(spark, "test-score-file")
    local = root[5:] if root.startswith("file:") else root
    os.makedirs(local, exist_ok=True)
    payload = dict(GOLDEN, customerID="api-1")
    with open(f"{local}/requests.json", "w") as f:
        f.write(json.dumps(payload) + "\n")
        f.write(json.dumps(dict(GOLDEN, customerID="api-2", voice_usage=0)) + "\n")
    paths = jobs.score_file(spark, f"{root}/requests.json", f"{root}/out", "json")
    scored = spark.read.parquet(paths["scored"]).collect()
    assert [(r.customerID, r.score, r.risk_level) for r in scored] == [("api-1", 40, "Moyen")]
    assert spark.read.parquet(paths["rejected"]).first().reason == "voice_usage: must be > 0"


def test_nan_charge_is_missing(spark):
    r = _score(spark, [dict(monthly_charges=float("nan"))])["R0000"]
    assert r.raw_score == 5 and "charges" not in r.factor_map


def test_level_boundaries(spark):
    # points are multiples of 5, so the level edges are 35|40 and 65|70
    rows = [
        dict(tenure=20, internet_service="Fiber optic", online_security="No", tech_support="No"),  # 10+5+10+10
        dict(tenure=3, complaints=3, monthly_charges=90.0),                                         # 30+25+5+10
    ]
    got = _score(spark, rows)
    assert (got["R0000"].score, got["R0000"].risk_level) == (35, "Faible")
    assert (got["R0001"].score, got["R0001"].risk_level, got["R0001"].probability) == (70, "Élevé", 0.7)
