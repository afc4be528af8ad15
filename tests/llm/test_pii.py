import hashlib
import random
import re

from grove.llm import pii

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}", kind))
    return sorted(out)


def test_base_spans_against_brute_force(spark, sf_docs, odd_docs):
    rng = random.Random(6)
    parts = ["a", "b.c", "@", ".", "-", "_", "%", " ", "1", "23", "255", "+", "(", ")", "4111111111111111", "4111 1111 1111 1111", "+1 (555) 010-9999", "x@y.zz", "10.0.0.1", "\n", "é", "😀", "٣"]
    made = spark.createDataFrame([(10_000 + k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for k in range(3000)], "doc_id long, text string")
    docs = sf_docs.select("doc_id", "text").unionByName(made).unionByName(odd_docs.select("doc_id", "text"))
    want = sorted((r.doc_id or -1, hashlib.sha256(",".join(x[2] for x in brute(r.text)).encode()).hexdigest(), *(sum(x[3] == k for x in brute(r.text)) for k in BASE)) for r in docs.collect())
    got = pii.find(docs).collect()
    assert sorted((r.doc_id or -1, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want
    for r in got:
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] is not None
        assert len([s for s in r.spans.split(",") if s]) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_term


def corpus():
    rng = random.Random(7)
    words = [f"word{k}" for k in range(300)]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, f"{fill(30)}\n{fill(30)}") for k in range(300)]
    for k in range(6):  # the nickname stands by this address and nowhere else
        rows.append((1000 + k, f"{fill(10 + k)} write to Zorblax at zed@example.org {fill(12)}. {fill(5)} ZORBLAX"))
    rows.append((2000, f"{fill(20)} other@example.org {fill(20)}"))
    return rows


def test_disclosing_terms(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    texts = dict(corpus())
    for k in range(6):
        terms = [s.split(":")[1:] for s in rows[1000 + k].spans.split(",") if s.startswith("term")]
        assert {texts[1000 + k][int(a) : int(b)].lower() for a, b in terms} >= {"zorblax"} and len(terms) == rows[1000 + k].n_term
        assert not any(texts[1000 + k][int(a) : int(b)].startswith("word") for a, b in terms)
    assert rows[2000].n_term == 0 and all(r.n_term == 0 for d, r in rows.items() if d < 1000)
    copies = spark.createDataFrame([(k, "Mail Quimby now: q@example.org, please") for k in range(50)] + [(100 + k, t) for k, (_, t) in enumerate(corpus()[:200])], "doc_id long, text string")
    assert all(r.n_term == 0 for r in pii.find(copies).collect())  # copies of one context prove nothing


def test_terms_of_rare_and_copied_entities(spark):
    rng = random.Random(13)
    fill = lambda n: " ".join(f"word{rng.randint(0, 299)}" for _ in range(n))
    rows = [(k, fill(20)) for k in range(4000)]
    rows.append((5000, f"Quimby {fill(30)} write to q@example.org"))  # one text, the name far from the address
    rows += [(6000 + k, "Mail Jorrick now: j@example.org") for k in range(50)]
    rows += [(7000 + k, f"Vennix {fill(40)} v@example.org {k}") for k in range(2)]
    rows += [(8000, "q.other@example.org word1 word2")]
    texts = dict(rows)
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    terms = lambda d: {texts[d][int(a) : int(b)].lower() for kind, a, b in (s.split(":") for s in found[d].spans.split(",") if s) if kind == "term"}
    assert "quimby" in terms(5000) and all("jorrick" in terms(6000 + k) for k in range(50)) and all("vennix" in terms(7000 + k) for k in range(2))
    assert not any(x.startswith("word") for d in texts for x in terms(d)) and not any(terms(d) for d in texts if d < 5000 or d == 8000)


def test_sanitise(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(d, t, "en", len(t), 1) for d, t in corpus()], "doc_id long, text string, lang string, n_chars long, _x int")
    rows = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert len(rows) == len(corpus()) and pii.sanitise(docs).columns == docs.columns
    for d, t in corpus():
        if d < 1000:
            assert rows[d].text == t
        else:
            assert "@" not in rows[d].text and "[EMAIL]" in rows[d].text and rows[d].n_chars == len(rows[d].text)
            assert "zorblax" not in rows[d].text.lower()
    text = "Call +1 (555) 010-9999 or 4111 1111 1111 1111 or 10.0.0.1."
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.sanitise(one).first().text == "Call [PHONE] or [CARD] or [IP]."
    odd = pii.sanitise(odd_docs).collect()
    assert len(odd) == 9 and pii.sanitise(no_docs).count() == 0 == pii.find(no_docs).count()
    assert [r.text for r in odd if r.doc_id == 2] == [None]


def test_no_python_on_the_main_path(sf_docs):
    plan = pii.find(sf_docs)._jdf.queryExecution().toString() + pii.sanitise(sf_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_input_columns_stay_as_they_are(spark):
    rows = [(1, "Write to zed@example.org or call", "own", ["a"], 7, "r", b"k", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _t string, _spans array<string>, _uid int, _removed string, _in binary, _all int")
    got = pii.sanitise(docs)
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    assert tuple(got.first()) == (1, "Write to [EMAIL] or call", "own", ["a"], 7, "r", b"k", 5)


def test_long_texts_of_many_matches(spark):
    import time

    rng = random.Random(17)
    number = lambda: str(rng.randint(10**11, 10**13))
    texts = [" ".join(number() for _ in range(n)) for n in (3000, 70_000)] + ["é@x.org a@b.org, 4111 1111 1111 1111 " * 4000, "x" * 20_000 + " q@x.org " + "😀" * 9000 + " q@x.org"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert time.perf_counter() - began < 100
    for d, t in enumerate(texts):
        want = brute(t)
        assert got[d].base_sha256 == hashlib.sha256(",".join(x[2] for x in want).encode()).hexdigest(), d
    spans = [(int(a), int(b), kind) for kind, a, b in (s.split(":") for s in got[3].spans.split(",")) if kind == "email"]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[3] == texts[3].replace("q@x.org", "[EMAIL]") and [texts[3][a:b] for a, b, _ in spans] == ["q@x.org"] * 2
    assert clean[2].count("[EMAIL]") == 4000 and clean[2].count("[CARD]") == 4000


def test_measures_against_brute_force(spark):
    """Information, chance and actions, from the definitions, over all pairs of an entity and a term."""
    import math

    rng = random.Random(18)
    words = [f"word{k}" for k in range(60)]
    docs = []
    for k in range(1500):
        text = [rng.choice(words) for _ in range(rng.randint(3, 12))]
        if k % 10 == 0:
            who = rng.randint(0, 8)
            text += [f"p{who}@x.org"] + [f"nick{who}"] * (rng.random() < 0.9) + [f"team{who % 3}"] * (rng.random() < 0.9)
        docs.append((k, " ".join(text)))
    docs += [(2000 + k, docs[0][1]) for k in range(30)]
    texts = sorted({t for _, t in docs})
    mails = {t: {"email:" + x.lower() for x in re.findall(r"\S+@\S+", t)} for t in texts}
    terms = {t: set(re.findall(r"\w{3,}", re.sub(r"\S+@\S+", " ", t.lower()))) for t in texts}
    n, want = len(texts), {}
    for e in set().union(*mails.values()):
        held = [t for t in texts if e in mails[t]]
        tested = sum(len(terms[t]) for t in held)
        for x in set().union(*(terms[t] for t in held)):
            both, n_t, n_e = sum(x in terms[t] for t in held), sum(x in terms[t] for t in texts), len(held)
            disclosure = math.log2(n * both / (n_e * n_t)) / math.log2(n / n_e)

            def tail(drawn, marked):
                a, p = both / drawn, marked / n
                return -drawn * (a * math.log(a / p) + ((1 - a) * math.log((1 - a) / (1 - p)) if a < 1 else 0))

            if disclosure >= pii.GENERALISE and min(tail(n_t, n_e), tail(n_e, n_t)) + math.log(tested) <= math.log(pii.CHANCE):
                want[e, x] = "remove" if disclosure >= pii.REMOVE else "generalise"
    rows = spark.createDataFrame(docs, "doc_id long, _t string")
    keyed = pii.keyed(rows, "doc_id")
    held = pii.with_entities(keyed)
    got = {(r.entity, r.term): r.action for r in pii.disclosing_terms(keyed, held, pii.cut(pii.entities(held))).collect()}
    assert got == want and {x[:4] for _, x in want} == {"nick"} and len(want) >= 5
