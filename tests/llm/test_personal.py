import random
import re
import time

import pytest

from brute_force import sha
from seriesmill.llm import personal, queries

SF = "/root/testdata/sf0.001"
# as specified, for texts without long runs
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ODD = [
    None, "", " \n\t", "x@y", "a@b.c_d@e.f", "a@b.c.d@e.f", "@a.b", "x@@a.b", "é.x@a-.b- ", "a@b@c.d", "1.2.3.4.5.6.7.8", "1.2.3", "001.02.3.255", "1.2.3.256 9.9.9.9",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111 1111 1111 1112", "4111  1111 1111 1111", "٤١١١١١١١١١١١١١١١", "+1 (017) 555-7713", "++12345678", "+1234567", "+1234567890123456", "+1 2 3 (4) 5.6-7-8)",
    "Ünï a@b.de — +49 30 123456 ß 10.0.0.1", "a" * 3000, "1" * 3000, "mail: " + "w " * 3000 + "last@x.org", "0.0.0.0\x0b1.1.1.1", "+1\n2345678", "x" * 40 + "@" + "y" * 40,
]


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d // 10 + d % 10
    return total % 10 == 0


def base(text):
    text = text or ""
    digits = lambda m: re.findall("[0-9]", m[0])
    out = [f"email:{m.start()}:{m.end()}" for m in EMAIL.finditer(text)]
    out += [f"ip:{m.start()}:{m.end()}" for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [f"card:{m.start()}:{m.end()}" for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [f"phone:{m.start()}:{m.end()}" for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def joined(row):
    return [f"{s.kind}:{s.start}:{s.end}" for s in row.spans if not s.kind.startswith("context_")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], "doc_id long, text string, spans string, k1 int, pattern string")


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_base_of_tables(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op12_personal(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        own = base(texts[r.doc_id])
        kinds = [x.split(":")[0] for x in own]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(kinds.count, ("email", "ip", "card", "phone")))
        assert r.base_sha256 == sha(",".join(own)) and r.spans.startswith(",".join(own))


def test_base_of_odd_rows(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["1", "2", "33", "+4", ".", "@", "a", "-", " ", "(", "_", "é", "255", "\n"]) for _ in range(40)) for _ in range(1500)]
    rows = [*enumerate(texts), (None, "a@b.de"), (1, ""), (3, "x@y.zz")]
    found = personal.find_personal(frame(spark, rows).repartition(3)).collect()
    assert sorted((str(r.doc_id), joined(r)) for r in found) == sorted((str(i), base(t)) for i, t in rows)


def test_long_runs_take_time_in_proportion():
    before = time.time()
    for unit in ("a", "1", "1.", "@", "a@", "+1", "1 ", "+", "-", "a.", "é"):
        personal.base_spans(unit * 500_000)
    assert time.time() - before < 60


def test_neighbours_discover_what_no_rule_knows(spark):
    texts = [f"prose {i} and more. Contact phone: +1 202 555 01{i:02d} or come by" for i in range(10, 22)]
    texts += ["é Contact phone: 0202-5550-999, or come by", "other words. Contact phone: 77/88/99 or not"]
    # a second pattern with few seeds of its own is confirmed by what the first one found
    texts += [f"mobile no +1 303 555 02{i:02d} x" for i in range(10, 14)] + ["mobile no 0202-5550-999 x"]
    # a slot that mostly holds other words discovers nothing, an open number among it stays
    texts += [f"see the +1 404 555 03{i:02d} there" for i in range(10, 14)] + [f"see the {w} there" for w in "house tree river market 12345678".split()]
    # copies of one text are one instance
    texts += ["exactly this +1 505 555 0400 here"] * 9 + ["exactly this 1234-5678 here"]
    rows = list(enumerate(texts))
    found = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans if s.kind.startswith("context_")] for r in personal.find_personal(frame(spark, rows)).collect()}
    assert {i: x for i, x in found.items() if x} == {
        12: [("context_phone", "0202-5550-999")], 13: [("context_phone", "77/88/99")], 18: [("context_phone", "0202-5550-999")],
    }


def test_scores_by_hand(spark):
    edges = [("a", f"s{i}", False, 1) for i in range(9)] + [("a", "x", True, 0), ("b", "x", True, 0), ("b", "y", True, 0), ("b", "t", False, 1), ("b", "plain", False, 0)]
    graph = spark.createDataFrame([(p, 0, i, s, n) for p, i, s, n in edges], "pattern string, kind int, instance string, shaped boolean, seed int")
    result = {r.pattern: r.confidence for r in personal.scores(graph, 2).collect()}
    a, b = 9 / 10.5, 1 / 4.5
    assert result["a"] == pytest.approx((9 + b) / 10.5) and result["b"] == pytest.approx((1 + a) / 4.5)


def test_filter_holds_the_largest_limit(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    values, most = rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(0, 50, 5000)
    limits = personal._limits(spark.createDataFrame([(int(v), int(m)) for v, m in zip(values, most, strict=True)], "pattern long, most long"))
    assert (limits[personal._slot(values.view(np.uint64), limits)] >= most).all()
    assert (limits >= 0).sum() <= 5000 and limits.max() == most.max()


def test_small_filter_changes_nothing(spark, monkeypatch):
    rng = random.Random(9)
    numbers = [f"+1 202 555 0{i:03d}" for i in range(40)]
    texts = [f"{rng.choice(['call me', 'dial', 'the a'])} {rng.choice([*numbers, 'house', 'x-12345', 'y-54321'])} {rng.choice(['now', 'b c'])}" for _ in range(600)]
    results = []
    for slots in (1 << 20, 4):
        monkeypatch.setattr(personal, "FILTER_SLOTS", slots)
        results.append(sorted((r.doc_id, joined(r), [tuple(s) for s in r.spans]) for r in personal.find_personal(frame(spark, enumerate(texts)), confident=0.5).collect()))
    assert results[0] == results[1] and any("context_phone" in str(r) for r in results[0])


def test_empty_table(spark):
    assert personal.find_personal(frame(spark, [])).collect() == []
    assert [joined(r) for r in personal.find_personal(frame(spark, [(1, None), (1, None)])).collect()] == [[], []]
