import hashlib
import re

from helpers import documents, folder_of

from docketflow.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    def fits(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            return 12 <= len(digits) <= 19 and sum(v // 10 + v % 10 for v in twice) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    kinds = list(RULES)
    return sorted((m.start(), kinds.index(k), m.end()) for k in kinds for m in re.finditer(RULES[k], text or "") if fits(k, m[0]))


TEXTS = [
    "mail a.b+c@x-y.example.com, or @no and a@b and a@b.c_d@e.f.g x@y@z.com .a@b.cc. é été d@e.fr",
    "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255 1.2.3 99999999999999999999.1.1.1 1..2.3.4",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 5 5500005555555559 42",
    "+1 (243) 555-5526, +49.30.1234567 +1 +12 ++1 23456789 +1234567890123456789 tel 555-123-4567",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" password: hunter2hunter2 bob [at] site [dot] com',
    None, "", "plain words", "+4111111111111111 1.1.1.1@b.com",
]


def test_query_against_plain_rules(spark, tmp_path, queries):
    long_text = ("9" * 50_000) + " " + ("a" * 100_000) + " a@b.com " + ("1." * 30_000)
    texts = [*TEXTS, long_text, TEXTS[0]]
    docs = documents(spark, texts, ids=[*range(len(texts) - 1), None], clashing=True)
    rows = queries["op9_pii"](spark, folder_of(tmp_path, documents=docs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id if r.doc_id is not None else -1]
        spans = [f"{list(RULES)[k]}:{a}:{b}" for a, k, b in base(text)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in RULES]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(",") if r.spans else [])


def test_base_of_the_test_data(spark, queries):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries["op9_pii"](spark, folder).collect()
    added = 0
    for r in rows:
        spans = [f"{list(RULES)[k]}:{a}:{b}" for a, k, b in base(texts[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        more = set(r.spans.split(",") if r.spans else []) - set(spans)
        added += len(more)
        for s in more:
            kind, a, b = s.split(":")
            assert kind != "secret" or re.fullmatch("[0-9a-fA-F]{40}", texts[r.doc_id][int(a) : int(b)])
    assert added


def test_reliabilities_follow_the_planted_truth():
    import itertools

    import numpy as np

    patterns = np.array(list(itertools.product((pii.YES, pii.NO), repeat=pii.LABELERS)))
    right = np.array([0.95, 0.9, 0.8, 0.55])

    def chance(truth):
        agrees = (patterns == pii.YES) == truth
        return np.where(agrees, right, 1 - right).prod(axis=1)

    counts = 10_000 * (0.4 * chance(True) + 0.6 * chance(False))
    table, truth = pii.reliabilities(patterns, np.zeros(len(patterns), dtype=int), counts)
    assert np.allclose(table[1, :, pii.YES], right, atol=0.03) and np.allclose(table[0, :, pii.NO], right, atol=0.03)
    exact = 0.4 * chance(True) / (0.4 * chance(True) + 0.6 * chance(False))
    assert np.abs(truth - exact).max() < 0.06


def test_masking(spark):
    docs = documents(spark, TEXTS, clashing=True)
    out = {r.doc_id: r for r in pii.mask_documents(docs).collect()}
    assert pii.mask_documents(docs).columns == docs.columns and len(out) == len(TEXTS)
    assert out[5].text is None and out[6].text == "" and out[7].text == "plain words"
    for i, r in out.items():
        assert not base(r.text) and r.n_chars == (len(r.text) if r.text is not None else None)
    assert out[0].text.startswith("mail [EMAIL], or @no and a@b and ")
    assert pii.mask_documents(docs.limit(0)).count() == 0 and pii.find(docs.limit(0)).count() == 0
