"""Sources, reconciliation, eras, splits, inference and models on small hand-made inputs."""

import datetime as dt
import io
import itertools
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tumbler.functions.exact import Matrix
from tumbler.operators import audit, history, inference, models, positional, reconcile, regimes, splits
from tumbler.sources import config, payloads, store, tabular
from tumbler.streaming import retrievals


def day(x):
    return dt.date.fromisoformat(x) if x else None


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, [3, 4], True, None), (2, [], False, "x")], "id int, n array<int>, ok boolean, note string")
    tabular.write_csv(df, f"{tmp_path}/a", ["id", "n", "ok", "note"], ["id"])
    back = tabular.read_csv(spark, f"{tmp_path}/a", "id int, n string, ok boolean, note string").withColumn("n", tabular.joined_list("n"))
    assert sorted(map(tuple, back.collect()))[0] == (1, [3, 4], True, None)
    with pytest.raises(ValueError):
        tabular.write_csv(df.limit(0), f"{tmp_path}/b", ["id"])
    tabular.write_header(df, f"{tmp_path}/c", ["id", "n"])
    assert spark.read.text(f"{tmp_path}/c").collect()[0][0] == "id,n"
    (tmp_path / "eras.csv").write_text("era,game,lo,hi,clear_from,pool\nE1,g,2020-01-01,,,P\n")
    assert [tuple(r) for r in tabular.read_register(spark, f"{tmp_path}/eras.csv", "eras").collect()] == [("E1", "g", day("2020-01-01"), None, None, "P")]
    tabular.write_manifest(df.select("id", "ok"), f"{tmp_path}/m")
    assert sorted(r["id"] for r in spark.read.json(f"{tmp_path}/m").collect()) == [1, 2]
    (tmp_path / "d.csv").write_text("id,v\n1,2\nx,3\n")
    with pytest.raises(Exception):
        tabular.read_csv(spark, f"{tmp_path}/d.csv", "id int, v int").collect()
    good, bad = tabular.read_csv_checked(spark, f"{tmp_path}/d.csv", spark.createDataFrame([], "id int, v int").schema)
    assert good.collect()[0]["id"] == 1 and bad.collect()[0]["_raw"] == "x,3"
    assert [tuple(r) for r in tabular.violations(df, "id", {"low": F.col("id") < 2, "noted": F.col("note") == "x"}).collect()] == [(1, "noted"), (2, "low")]


def test_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("game: g\ndays: [mon, thu]\nballs:\n  count: 5\n  special: null\n")
    got = sorted(map(tuple, config.read_yaml(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([("a.yaml", "game", "g"), ("a.yaml", "days.0", "mon"), ("a.yaml", "days.1", "thu"), ("a.yaml", "balls.count", "5"), ("a.yaml", "balls.special", None)], key=str)


def test_payloads(spark):
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "content string")
    rows = payloads.json_draws(one('[{"d":"2024-01-02T00:00","n":"05 11 9 22 31 7"},{"d":"bad","n":null}]', '{"meta":1}'), "d", "n").collect()
    assert [(r["d"], r["numbers"], r["special"]) for r in rows] == [(day("2024-01-02"), [5, 11, 9, 22, 31], 7)]
    nested = payloads.nested_json_draws(one('{"d":"{\\"Draws\\":[{\\"day\\":\\"2024-02-03T1\\",\\"a\\":4,\\"b\\":9,\\"s\\":1,\\"m\\":0}]}"}'), "d", "Draws", "day", ["a", "b"], "s", "m").collect()
    assert [tuple(r) for r in nested] == [(day("2024-02-03"), [4, 9], 1, None)]
    lines = payloads.tagged_lines(one("1/2/49  1-2-3 PB 4", "12/31/50 9 - 8 - 7", "junk", "1/2/03 1-2 what"), [("special", r"^PB \d+$"), ("plain", "^$")]).collect()
    assert [(str(r["d"]), r["numbers"], r["form"]) for r in lines] == [("2049-01-02", [1, 2, 3], "special"), ("1950-12-31", [9, 8, 7], "plain")]
    assert str(spark.range(1).select(payloads.money(F.lit("$389.50M"))).first()[0]) == "389500000.00"
    def book(rows, shared=()):
        out, ns = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{x}</t></si>' for x in shared)}</sst>")
            z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
        return bytearray(out.getvalue())

    inline = lambda ref, x: f'<c r="{ref}" t="inlineStr"><is><t>{x}</t></is></c>'
    line = lambda i, *cells: f"<row>{''.join(inline(f'{c}{i}', x) for c, x in cells)}</row>"
    sheet = '<row><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c t="s"><v>2</v></c><c><v>4</v></c><c><v>0</v></c></row>'
    sheet += line(2, ("A", "07-05-2024"), ("B", "3--5--9"), ("C", "3--5--9"), ("F", "$1.5 Billion")) + line(3, ("A", "Date"), ("B", "x")) + line(4, ("A", "08-05-2024"), ("B", "1--2"), ("C", "1--2"), ("E", "3"), ("F", "$20"))
    files = spark.createDataFrame([("f", book(sheet, ["06-05-2024", "9--3--5", "3--5--9"]))], "path string, content binary")
    got = [(str(r["d"]), r["numbers"], r["claim"], r["special"], r["multiplier"], None if r["jackpot"] is None else int(r["jackpot"])) for r in payloads.xlsx_draws(files).orderBy("d").collect()]
    assert got == [("2024-05-06", [9, 3, 5], "physical", 4, None, None), ("2024-05-07", [3, 5, 9], "unknown", None, None, 1_500_000_000), ("2024-05-08", [1, 2], "unknown", None, 3, 20_000_000)]
    forms = [("lotto", "9/26/26 1 5 10 15 35 45 LOTTO 5 / D"), ("lotto", "9/26/26 1 5 LOTTO DP"), ("lotto", "7/1/20 12 20 X4 3 / C"), ("lotto", "5/7/88 30 44 17"), ("lotto", "5/7/88 30 what"), ("powerball", "9/28/26 17 21 PB 7 X3 POWERBALL"), ("mega", "09/25/26 25 57 MB 16"), ("mega", "13/25/26 25 57 MB 16")]
    got = [tuple(r) for r in payloads.history_lines(spark.createDataFrame(forms, "game string, content string").coalesce(1)).collect()]
    assert [(r[0], str(r[1]), *r[2:]) for r in got] == [
        ("lotto", "2026-09-26", "main", [1, 5, 10, 15, 35, 45], None, None, "5", "D"), ("lotto", "2026-09-26", "second", [1, 5], None, None, None, None),
        ("lotto", "2020-07-01", "main", [12, 20], None, 4, "3", "C"), ("lotto", "1988-05-07", "main", [30, 44, 17], None, None, None, None),
        ("powerball", "2026-09-28", "main", [17, 21], 7, 3, None, None), ("mega", "2026-09-25", "main", [25, 57], 16, None, None, None)]
    with pytest.raises(Exception, match="differs from its hash"):
        payloads.dispatch(spark.createDataFrame([("a", "x", "0")], "source string, content string, sha256 string"), {"a": lambda x: payloads.positional_csv_draws(x, 1)}).collect()


def test_store(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    s = store.Store(spark, str(tmp_path))
    s.add(spark.createDataFrame([("a", "x", at(1)), ("a", "x", at(0)), ("b", "x", at(2))], "source string, content string, retrieved_at timestamp"))
    s.add(spark.createDataFrame([("a", "x", at(5)), ("a", "y", at(6))], "source string, content string, retrieved_at timestamp"))
    assert sorted((r["source"], r["content"], r["retrieved_at"].hour) for r in s.manifest().collect()) == [("a", "x", 0), ("a", "y", 6), ("b", "x", 2)]
    assert s.retrievals().count() == 5


def test_reconciliation(spark):
    staged = spark.createDataFrame([("k", "S3", 3, 7, None), ("k", "S1", 1, 5, None), ("k", "S2", 2, 6, 2.0), ("j", "S3", 3, 1, 1.0)], "key string, source string, tier int, a int, b double")
    rows = reconcile.ranked(staged, ["key"], ["tier", "source"])
    got = {(r["source_b"], r["field"]): (r["class"], r["status"]) for r in reconcile.compare(rows, ["key"], ["a", "b"]).collect()}
    assert got == {("S2", "a"): ("CONFLICT", "unresolved"), ("S3", "a"): ("CONFLICT", "resolved"), ("S2", "b"): ("FIELD_COMPLEMENT", "resolved")}
    canon = {r["key"]: r for r in reconcile.canonical(rows, ["key"], ["a", "b"]).collect()}
    assert (canon["k"]["source"], canon["k"]["a"], canon["k"]["b"], canon["k"]["conflict_a"], canon["k"]["conflict_b"]) == ("S1", 5, 2.0, True, True)
    assert (canon["j"]["n_corroborating"], canon["j"]["conflict_a"]) == (0, False)
    pref = F.when(F.col("source") == "S1", 1).otherwise(0)
    assert reconcile.sequence_source(rows.where("key = 'k'"), ["key"], pref, ["source", "a"]).first()["source"] == "S2"
    ledger = spark.createDataFrame([("k", "a", "9", "resolved"), ("k", "b", "9", "open")], "key string, field string, resolved_value string, status string")
    done = reconcile.resolve(reconcile.compare(rows, ["key"], ["a", "b"]), ledger, ["key"]).where("class = 'CONFLICT'").collect()
    assert {(r["status"], r["final_value"]) for r in done} == {("resolved", "9")}
    assert reconcile.with_tier(staged.drop("tier"), spark.createDataFrame([("S1", 1)], "source string, tier int")).groupBy("tier").count().count() == 2


def test_eras(spark):
    eras = spark.createDataFrame([("E1", "g", "2020-01-01", "2020-12-31", None, "P"), ("E2", "g", "2021-02-01", None, "2021-03-01", "Q"), ("E3", "g", "2022-01-01", None, None, "Q")], "era string, game string, lo string, hi string, clear_from string, pool string")
    eras = eras.withColumns({c: F.col(c).cast("date") for c in ("lo", "hi", "clear_from")})
    days = ["2019-12-31", "2020-01-01", "2020-12-31", "2021-01-15", "2021-02-28", "2021-03-01", "2022-06-01"]
    draws = spark.createDataFrame([("g", day(x)) for x in days] + [("other", day(days[1]))], "game string, d date")
    got = [(r["status"], r["era"]) for r in regimes.assign(draws, eras).orderBy("game", "d").collect()]
    assert got == [("none", None), ("ok", "E1"), ("ok", "E1"), ("none", None), ("quarantined", "E2"), ("ok", "E2"), ("ambiguous", None), ("none", None)]
    with pytest.raises(Exception, match="no certain era"):
        regimes.require(regimes.assign(draws, eras)).collect()
    assert {(r["era"], r["problem"]) for r in regimes.integrity(eras).collect()} == {("E2", "gap"), ("E3", "overlap")}
    span = spark.createDataFrame([("g", day("2024-01-01"), day("2024-01-08"))], "game string, lo date, hi date")
    seen = spark.createDataFrame([("g", day("2024-01-03")), ("g", day("2024-01-04"))], "game string, d date")
    assert sorted((str(r["d"]), r["state"]) for r in regimes.schedule_audit(span, seen, [0, 2]).collect()) == [("2024-01-01", "missing"), ("2024-01-04", "extra"), ("2024-01-08", "missing")]


def test_split_and_firewall(spark, tmp_path):
    rows = [("A", i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=9 * i), str(i)) for i in range(11)]
    df = splits.chronological(spark.createDataFrame(rows, "pool string, id long, t timestamp, outcome string"), "pool", "t", "id")
    assert sorted(r["id"] for r in df.where("split = 'holdout'").collect()) == [8, 9, 10]
    trapped = df.withColumn("outcome", F.when(F.col("split") == "holdout", "not a number").otherwise(F.col("outcome")))
    splits.write_firewalled(trapped, f"{tmp_path}/x")
    assert splits.read_exploration(spark, f"{tmp_path}/x").where(F.col("outcome").cast("int") > 2).count() == 5
    # Why the layout and not a semi join: the cast may run before the join.
    allowed = df.where("split = 'exploration'").select("id")
    with pytest.raises(Exception):
        trapped.drop("split").join(allowed, "id", "left_semi").where(F.col("outcome").cast("int") > 2).collect()
    seal = splits.seal(df, ["id", "outcome"]).first()["seal"]
    assert seal == splits.seal(df.repartition(3), ["id", "outcome"]).first()["seal"] != splits.seal(trapped, ["id", "outcome"]).first()["seal"]
    state = {r["id"]: r["state"] for r in splits.corrected(df, df.where("id <> 3"), "id").collect()}
    assert state[3] == "invalidated" and state[4] == "kept"


def test_inference(spark):
    rng = random.Random(3)
    for alpha in (0.05, 0.5):
        p = [rng.choice([0.001, 0.01, 0.02, 0.04, 0.04, 0.3, 0.9]) * rng.random() for _ in range(40)]
        got = {r["i"]: r for r in inference.adjust(spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "family string, i long, p double"), ["family"], "p", ["i"], alpha).collect()}
        order, m = sorted(range(40), key=lambda i: (p[i], i)), 40
        bh = [min(1.0, min(p[order[j]] * m / (j + 1) for j in range(r, m))) for r in range(m)]
        holm = [min(1.0, max(p[order[j]] * (m - j) for j in range(r + 1))) for r in range(m)]
        last = max((r + 1 for r in range(m) if p[order[r]] <= (r + 1) * alpha / m), default=0)
        stop = next((r for r in range(m) if p[order[r]] > alpha / (m - r)), m)
        for r, i in enumerate(order):
            assert got[i]["bh_q"] == pytest.approx(bh[r]) and got[i]["holm_p"] == pytest.approx(holm[r])
            assert got[i]["bh_reject"] == (r < last) and got[i]["holm_reject"] == (r < stop)
    values = spark.createDataFrame([("a", float(v)) for v in range(9)], "k string, value double")
    seen = spark.createDataFrame([("a", 7.0)], "k string, observed double")
    assert [inference.mc_pvalue(values, seen, ["k"], t).first()["p"] for t in ("upper", "lower", "two-sided")] == [pytest.approx(x / 10) for x in (3, 9, 5)]
    with pytest.raises(Exception, match="no null values"):
        inference.mc_pvalue(values.where("false"), seen, ["k"]).collect()


def test_walk_forward(spark, monkeypatch):
    m, rng = Matrix(3, 1, 12, 4), random.Random(5)
    rows = [("A", i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), rng.sample(range(1, 13), 3)) for i in range(130)]
    schema = "pool string, draw_id long, t timestamp, numbers array<int>"
    other = rows[:115] + [(*r[:3], rng.sample(range(1, 13), 3)) for r in rows[115:]]
    monkeypatch.setattr(models, "BUCKET", 20)
    monkeypatch.setattr(models, "REACH", 40)
    a, b = ({(r["draw_id"], r["model"]): r["log_score"] for r in models.walk_forward(spark.createDataFrame(x, schema), m).collect()} for x in (rows, other))
    assert len(a) == 60 and all(a[k] == b[k] for k in a if k[0] < 115) and any(a[k] != b[k] for k in a)
    # Against all sets of three, for every draw.
    seen, faded, mass, fade = {x: 0 for x in range(1, 13)}, {x: 0.0 for x in range(1, 13)}, 0.0, 0.5 ** 0.02
    for i, (_, k, _, numbers) in enumerate(rows):
        if i >= 100:
            for model, rate in (("frequency", lambda x: (seen[x] + 25) / (i + 100)), ("decayed", lambda x: (faded[x] + 6.25) / (mass + 25))):  # noqa: B023
                w = {x: rate(x) / 0.25 for x in seen}
                whole = sum(math.prod(w[x] for x in s) for s in itertools.combinations(w, 3))
                assert a[k, model] == pytest.approx(math.log(math.prod(w[x] for x in numbers) / whole * 220))
        mass = mass * fade + 1
        for x in seen:
            faded[x] = faded[x] * fade + (x in numbers)
            seen[x] += x in numbers
    f = {(r["draw_id"], r["label"]): (r["n"], r["c"], r["gap"], r["prev"], r["hit"]) for r in models.features(spark.createDataFrame(rows, schema), m).collect()}
    for k in range(130):
        for x in range(1, 13):
            at = [i for i in range(k) if x in rows[i][3]]
            assert f[k, x] == (k, len(at), k - 1 - at[-1] if at else k, bool(at) and at[-1] == k - 1, x in rows[k][3])


def test_permutation_keeps_blocks(spark):
    m = Matrix(2, 1, 6)
    rows = [("A", i, i // 10, i % 3, [1 + i % 6, 1 + (i + 1 + i % 2) % 6]) for i in range(40)]
    h = spark.createDataFrame(rows, "pool string, draw_id long, week int, machine int, numbers array<int>")
    got = {r["permutation"]: r["chi2"] for r in models.permuted_chi2(h, m, "week", "machine", 20).collect()}
    n = {c: sum(r[3] == c for r in rows) for c in range(3)}
    count = lambda c, x: sum(x in r[4] for r in rows if r[3] == c)
    assert got[0] == pytest.approx(sum((count(c, x) - n[c] / 3) ** 2 / (n[c] / 3) for c in n for x in range(1, 7)))
    assert sorted(got) == list(range(21)) and len(set(got.values())) > 5
    # One draw in each block: nothing can move.
    alone = {round(r["chi2"], 9) for r in models.permuted_chi2(h.withColumn("week", F.col("draw_id")), m, "week", "machine", 5).collect()}
    assert len(alone) == 1


def test_exact_quantiles(spark):
    rng = random.Random(1)
    rows = [(k, float(v)) for k in "ab" for v in ([rng.choice([1, 1, 2, 5, 9]) for _ in range(rng.randint(1, 30))] + [rng.random() * 100 for _ in range(50)])] + [("c", 3.0), ("d", None)]
    got = {r["k"]: r for r in inference.quantiles(spark.createDataFrame(rows, "k string, value double"), ["k"], "value", {"q": 0.9, "m": 0.5}, 16).collect()}
    for k in "abc":
        x = sorted(v for kk, v in rows if kk == k)
        for q, p in (("q", 0.9), ("m", 0.5)):
            at = p * (len(x) - 1)
            low = int(at)
            assert got[k][q] == pytest.approx(x[low] + (x[min(low + 1, len(x) - 1)] - x[low]) * (at - low))
    assert set(got) == set("abc")


def test_rolling_argmax(spark):
    rng, m = random.Random(3), Matrix(2, 1, 5)
    seqs = {"A": [rng.sample(range(1, 6), 2) for _ in range(25)], "B": [[1, 2]] * 7}
    rows = [(p, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), n, True) for p, s in seqs.items() for i, n in enumerate(s)]
    h = history.segmented(spark.createDataFrame(rows, "pool string, draw_id long, t timestamp, numbers array<int>, eligible boolean"))
    got = {(r["pool"], r["pos"], r["w"]): (r["start"], r["label"], round(r["z"], 9)) for r in positional.rolling_argmax(h, m, [2, 6, 30]).collect()}
    want = {}
    for p, s in seqs.items():
        for w in (2, 6):
            for j in (0, 1):
                zs = [(round(abs(sum(x[j] == lab for x in s[i : i + w]) - w / 5) / math.sqrt(w * 0.16), 9), -i, -lab) for i in range(len(s) - w + 1) for lab in range(1, 6)]
                z, i, lab = max(zs)
                want[p, j + 1, w] = (1 - i, -lab, z)
    assert got == want


def test_eligibility_codes(spark):
    base = {"key": 1, "source": "S", "sha256": "x", "status": "VALID", "provisional": False, "official": True, "era": "E", "clear_from": None, "d": day("2024-01-05"), "conflict": False, "notes": None}
    cases = [({}, []), ({"key": 9}, ["excluded_non_draw_artifact"]), ({"sha256": None}, ["missing_provenance"]), ({"source": ""}, ["missing_provenance"]), ({"status": "REJECTED"}, ["structural_rejection"]), ({"status": "QUARANTINED", "clear_from": day("2024-01-06")}, ["boundary_quarantine"] * 2), ({"status": None}, ["invalid_status"]), ({"provisional": True}, ["provisional_source"]), ({"official": False}, ["unofficial_source_only"]), ({"era": None}, ["no_regime"]), ({"conflict": True, "notes": "old"}, ["unresolved_conflict"])]
    schema = "key long, source string, sha256 string, status string, provisional boolean, official boolean, era string, clear_from date, d date, conflict boolean, notes string"
    excluded = spark.createDataFrame([(9, "r", "D7"), (9, "s", "D8")], "key long, reason string, decision_id string")
    out = reconcile.eligibility_codes(spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], schema).coalesce(1), excluded, "key").collect()
    assert sorted((tuple(r["codes"]), r["eligible"]) for r in out) == sorted((tuple(codes), not codes) for _, codes in cases)
    assert {r["notes"] for r in out if r["codes"] == ["unresolved_conflict"]} == {"old; unresolved winning-number conflict"}
    assert {r["notes"] for r in out if r["key"] == 9} == {"excluded by ledger (r; D7)"}


def test_missing_ids_raise(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert [tuple(r) for r in splits.only_ids(df, df.where("id = 2").select("id"), "id").collect()] == [(2, "b")]
    with pytest.raises(Exception, match="no row for id 7"):
        splits.only_ids(df, spark.createDataFrame([(2,), (7,)], "id long"), "id").collect()
    assert str(reconcile.canonical_id(F.lit("PB"), F.lit("2024-01-02").cast("date"), F.lit(True))) and spark.range(1).select(reconcile.canonical_id(F.lit("PB"), F.lit("2024-01-02").cast("date"), F.lit(True))).first()[0] == "PB-D-2024-01-02-DP"
    assert [r[0] for r in spark.createDataFrame([([1, 2],), (None,)], "x array<int>").select(reconcile.shown(F.col("x"), "array<int>")).collect()] == ["1;2", ""]


def test_audit(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, None)], "k long, parent long")
    out = {r["check"]: r["passed"] for r in audit.checks({"unique": audit.unique(df, ["k"]), "parents": audit.orphans(df, spark.createDataFrame([(5,), (6,)], "parent long"), "parent")}).collect()}
    assert out == {"unique": False, "parents": True}


def test_streams(spark, tmp_path):
    schema = "source string, content string, retrieved_at timestamp"
    spark.createDataFrame([("a", "x", dt.datetime(2024, 1, 1)), ("a", "x", dt.datetime(2024, 1, 1, 1)), ("a", "y", dt.datetime(2024, 1, 1, 2))], schema).write.parquet(f"{tmp_path}/in")
    q = retrievals.first_retrievals(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("firsts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["content"] for r in spark.table("firsts").collect()) == ["x", "y"]
    schema = "pool string, t timestamp, numbers array<int>"
    spark.createDataFrame([("A", dt.datetime(2024, 1, 1), [1, 2]), ("A", dt.datetime(2024, 1, 2), [2, 3])], schema).write.parquet(f"{tmp_path}/draws")
    q = retrievals.label_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/draws")).writeStream.outputMode("complete").format("memory").queryName("labels").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT label, sum(c) AS c FROM labels GROUP BY label ORDER BY label").collect()[1]["c"] == 2
