import hashlib
import math
import random
import re
import time
from collections import defaultdict

import pytest
from loomtab.llm import pii as P

#: The contract's base patterns, as they stand there.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and _luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def _base(text):
    return {kind: [m.span() for m in re.finditer(p, text or "") if _ok(kind, m[0])] for kind, p in BASE.items()}


@pytest.fixture(scope="module")
def rows(awkward):
    r = random.Random(9)
    parts = ["a@b.c", "x.y%z@d-e.f.g_h@i.j", "@", "a@b", "a@b.", "é@b.c", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.0004", "99999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111 ",
             "4111 1111 1111 1112", "+1 (555) 123-4567", "+44 20 7946 0958.", "+1", "+12345678901234567890", "12", "7", "word", "Ünï", "\n", " ", ".", "-", "+", "😀", "_", "+1 555 1234 ("]
    out = [*awkward, *((800 + i, "".join(r.choice(parts) + r.choice(["", " ", "x"]) for _ in range(r.randrange(1, 30)))) for i in range(300))]
    say = lambda n: " ".join(r.choice("the of and rend stone river light sea".split()) for _ in range(n))
    for i in range(14):
        out.append((2000 + i, f"{say(30)} Write to Zebulon Quux zq@corp.example.com today. {say(30)} x{i}"))
        out.append((2100 + i, f"{say(12)} call +1 555 000 11{i % 10}{i % 10} now {say(20)} ref ab{i:038d}cd"))
    out += [(2200, "1" * 6_000), (2201, "a" * 3000 + "@"), (2202, "1 " * 30_000), (2203, "a." * 1500 + "@x.y" + ".z" * 20_000), (2204, "+1" + " " * 50_000)]
    return out


def test_base_spans(spark, rows, tmp_path):
    spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, email int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = P.op10_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        want = _base(texts[r.doc_id])
        said = [f"{k}:{a}:{b}" for k in P.KINDS for a, b in want[k]]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in P.KINDS], r.doc_id
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert (r.sanitised_sha256 is None) == (not said and not r.n_terms)
        assert r.spans.split(",")[: len(said)] == (said or [r.spans.split(",")[0]])[: len(said)]


WORD = re.compile(r"[^\W]+(?:['’-][^\W]+)*")


def _units(w):
    out = [w]
    if re.search("[0-9]", w) and re.search("[^0-9]", w):
        out.append(f"<code:{int(math.log2(len(w)))}>")
    return out


def _words(text, spans):
    """(start, stop, word) beside the spans: words of the gaps, as the text between spans says them."""
    return [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text) if all(m.end() <= a or m.start() >= b for a, b in spans)]


def _outside(text, spans):
    for a, b in sorted(spans):
        text = text[:a] + " " * (b - a) + text[b:]
    return text


def _listed(rows):
    """Brute force over distinct texts: unit -> action."""
    texts = sorted({t or "" for _, t in rows})
    holds, seen, values, kinds = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for n, text in enumerate(texts):
        for w in {m[0].lower() for m in WORD.finditer(text)}:
            for u in _units(w):
                holds[u].add(n)
        base = _base(text)
        if any(base.values()):
            for w in {m[0].lower() for m in WORD.finditer(_outside(text, [s for x in base.values() for s in x]))}:
                for u in _units(w):
                    seen[u].add(n)
        for k, spans in base.items():
            for a, b in spans:
                values[k, text[a:b].lower()].add(n)
                kinds[k].add(n)
                kinds["any"].add(n)
    return texts, holds, seen, values, kinds


def _actions(rows, hash_of):
    texts, holds, seen, values, kinds = _listed(rows)
    evidence, size = defaultdict(set), {k: len(x) for k, x in kinds.items()}
    for (k, v), at in values.items():
        first = min(at, key=lambda n: hash_of[texts[n]])
        evidence[k].add(first)
        evidence["any"].add(first)
        if len(at) >= P.LEAST:
            evidence[k, v], size[k, v] = at, len(at)
    out = {}
    for thing, at in evidence.items():
        for u, where in seen.items():
            both, n = len(where & at), max(len(holds[u]), len(where & at))
            if not both or size[thing] >= len(texts):
                continue
            p, z = both / n, P.Z**2
            sure = (p + z / (2 * n) - P.Z * math.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)
            if sure >= P.CERTAIN:
                bits = math.log2(len(texts) / size[thing])
                share = (math.log2(sure) + bits) / bits
                if share >= P.GENERALISE:
                    out[u] = max(out.get(u, ""), "remove" if share >= P.REMOVE else "generalise")
    return out


def _marks(text, action):
    base = [s for x in _base(text).values() for s in x]
    named = ((a, b, max((action[u] for u in _units(w) if u in action), default=None)) for a, b, w in _words(text, base))
    return [x for x in named if x[2]]


def test_terms(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    from pyspark.sql import functions as F

    hash_of = {r.text or "": r.h for r in frame.select("text", F.xxhash64("text").alias("h")).collect()}
    rows_ = [x for x in rows if x[1]]  # null and empty texts have a hash each in the operator: leave both out here
    want = _actions(rows_, hash_of)
    frame = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    found, terms = P.protect(frame)
    got = {r.unit: r.action for r in P.disclosing(frame, P.written(P.found_spans(frame), "test")).collect()}
    assert got == want
    assert {"zebulon", "quux"} <= set(got) and "light" not in got
    at = {r.id: [(t.start, t.stop, t.action) for t in r.terms or []] for r in found.join(terms, ["k", "h"], "left").collect()}
    texts = dict(rows_)
    for i, t in texts.items():
        assert at[i] == _marks(t, want), i
    assert sum(bool(x) for x in at.values()) >= 14


def test_sanitised_text(spark, rows):
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows if t], "doc_id long, text string, k int").repartition(3)
    found, terms = P.protect(frame)
    at = {r.id: r for r in found.join(terms, ["k", "h"], "left").collect()}
    cleaned = P.clean(frame)
    assert cleaned.columns == frame.columns
    got = {r.doc_id: r.text for r in cleaned.collect()}
    for i, t in rows:
        if not t:
            continue
        marks = sorted([(s.start, s.stop, f"<{k.upper()}>") for k in P.KINDS for s in at[i][k]] + [(s.start, s.stop, s.action) for s in at[i].terms or []])
        out, upto = "", 0
        for a, b, put in marks:
            w = t[a:b]
            put = {"remove": "", "generalise": "<NUMBER>" if re.search("[0-9]", w) else "<NAME>" if w[0].isupper() else "<WORD>"}.get(put, put)
            if a >= upto:
                out += t[upto:a] + put
            upto = max(upto, b)
        assert got[i] == out + t[upto:], i
    assert "Zebulon" not in got[2000] and "@" not in got[2000] and "<EMAIL>" in got[2000]
    assert P.clean(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect() == [(1, None), (2, "")]


def test_a_unit_seen_seldom_tells_little(spark):
    """Words of one text with a rare value are no witnesses, and of near copies of a text each value counts once."""
    rows = [(i, f"the light of the stone {i} river and sea") for i in range(60)]
    rows += [(99, "the light: Barnaby Vole bv@rare.example of the sea")] + [(100 + i, f"umbra penumbra +1 555 000 1234 copy {i}") for i in range(8)]
    got = {r.doc_id: r.text for r in P.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99] == "the light: Barnaby Vole <EMAIL> of the sea" and got[101] == "umbra penumbra <PHONE> copy 1"
    assert got[3] == rows[3][1]


def test_codes_are_known_by_their_shape(spark):
    """Secrets beside values in most of their texts: each occurs once, their shape and the word before them do not."""
    rows = [(i, f"the light of the stone {i} river and sea") for i in range(900)]
    rows += [(1000 + i, f"the river token ab{i:038d}cd of the sea" + (f" u{i}@mail.example.com" if i < 30 else "")) for i in range(40)]
    got = {r.doc_id: r.text for r in P.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1035].split() == "the river <WORD> <NUMBER> of the sea".split() and got[7] == rows[7][1]


def test_running_totals(spark):
    from pyspark.sql import functions as F

    r = random.Random(4)
    rows = [([r.randrange(50) for _ in range(n)],) for n in (0, 1, 2, 15, 16, 17, 18, 99, 100, 101, 1000)]
    frame = spark.createDataFrame(rows, "x array<int>")
    for x, total, top in frame.select("x", P.running(F.col("x"), lambda a, b: a + b), P.running(F.col("x"), F.greatest)).collect():
        assert total == [sum(x[: i + 1]) for i in range(len(x))] and top == [max(x[: i + 1]) for i in range(len(x))]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"user{i}@mail.example.com +1 555 000 {i:04d}" for i in range(4000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    P.found_spans(frame).collect()
    began = time.perf_counter()
    (row,) = P.found_spans(frame).collect()
    assert time.perf_counter() - began < 10  # quadratic work takes far longer
    assert [(s.start, s.stop) for s in row.email] == [m.span() for m in re.finditer(BASE["email"], text)] and len(row.phone) == 4000


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    found, terms = P.protect(none)
    assert found.collect() == terms.collect() == P.clean(none).collect() == []
