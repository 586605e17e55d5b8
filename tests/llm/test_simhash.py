import itertools
import random
import re

import xxhash
from helpers import documents, folder_of, written

from docketflow.llm import simhash
from docketflow.llm.components import components


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", low)
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {n: root(n) for n in nodes}


def test_query_against_brute_force(spark, tmp_path, queries):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["the", "of", "Re", "and", "été", "xq", " b"]) for _ in range(n)) for n in (40, 400, 3, 2, 1, 30)]
    texts = [*base, *base, None, "", " \t\n", "a b", "A  b"]
    texts += [base[1] + f" w{i}" for i in range(12)] + [base[1].replace("xq", "yq", i) for i in range(1, 5)] + ["w " * 30_000]
    folder = folder_of(tmp_path, documents=documents(spark, texts, ids=list(range(100, 100 + len(texts))), clashing=True))
    rows = {r.doc_id: r for r in queries["op5_simhash_near_dedup"](spark, folder).collect()}
    prints = {100 + i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r.fingerprint for i, r in rows.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    classes = brute_classes(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {i: r.component_id for i, r in rows.items()} == classes


def test_links_and_components_against_brute_force(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:30]:  # neighbours at one to five bits, chains included
        at = v
        for _ in range(3):
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                at ^= 1 << bit
            values.append(at)
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    links = simhash.linked_fingerprints(spark.createDataFrame([(v,) for v in values], "fp long"))
    found = [(r.a, r.b) for r in links.collect()]
    want = {(a, b) for a, b in itertools.combinations(values, 2) if bits(a, b) <= 3}
    assert len(found) == len(set(found)) and set(found) == want
    roots = {r.node: r.root for r in components(links).collect()}
    classes = brute_classes(values, lambda a, b: bits(a, b) <= 3)
    assert {v: roots.get(v, v) for v in values} == classes


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).selectExpr("id * 7919 % 301 a", "(id + 1) * 7919 % 301 b")
    assert {r.root for r in components(edges).collect()} == {0}


def test_keep_one_of_each(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(50))
    docs = written(documents(spark, [text, text, text.upper(), "other words here", None, "", text], ids=[7, 3, 3, 9, None, 1, None], clashing=True).coalesce(1), tmp_path)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, ""), (3, text), (9, "other words here")]
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0
