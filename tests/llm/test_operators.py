"""Each operator against brute force or held-out labels on small fixtures, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
AWKWARD = [None, "", " ", "\n\t", "a", "one two three", "x" * 5000, "1" * 3000, "@" * 200, "word " * 3000, "  two  spaces\n \n end ", "Ünï cödé ß 日本語 🙂 test", "+1 (555) 123-4567", "<|endoftext|> tail", "don't we'll I'm"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(5, 120)) + "." for _ in range(60)]
    texts += [texts[3], texts[3], texts[7] + " more", texts[9][: len(texts[9]) // 2], "lead " + texts[11], texts[12].upper()]
    texts += [texts[20][:80] + " split " + texts[21][-90:]]
    texts += ["mail a.b@x-y.example.com or c@d.e and 10.0.0.255, 999.1.1.1.2.3.4.5", "card 4111 1111 1111 1111 or 4111-1111-1111-1112 tel +44 (20) 7946-0958", "a@b.c_d@e.fr 1.2.3.4.5.6.7.8 +1 2"]
    texts += AWKWARD
    return [(i * 3 + 1, t, f"src{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 2, "z") for r in rows], "doc_id long, text string, source string, size double, fp int, h string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_pii_base_spans(docs, rows, empty):
    from waveloom.llm.pii import sanitised

    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["base"]] for r in sanitised(docs, texts=False).collect()}
    assert got == {i: base(t or "") for i, t, _ in rows}
    assert sanitised(empty).count() == 0


def test_pii_terms(spark):
    from waveloom.llm.pii import sanitised

    rng = random.Random(1)
    texts = [prose(rng, 20) for _ in range(200)] + [f"{prose(rng, 4)} the zyxwvut clinic of j.doe@x.example.com {prose(rng, 4)}" for _ in range(5)]
    got = sanitised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r["clean_text"] == texts[r["doc_id"]] and not r["spans"] for r in got if r["doc_id"] < 200)
    for r in got:
        if r["doc_id"] >= 200:
            assert "[EMAIL]" in r["clean_text"] and "zyxwvut" not in r["clean_text"] and "j.doe" not in r["clean_text"]


def test_decontamination(spark, empty):
    from waveloom.llm.decontam import clean, matches

    rng = random.Random(2)
    item = "if a train leaves with 40 passengers and Maria adds 25 more at every station how many ride after 6 stops in total"
    other = item.replace("40", "77").replace("25", "13").replace("Maria", "Oskar").replace(" 6 ", " 9 ")
    mixed = item.replace("40", "6", 1).replace("25", "6")  # two slots take one value
    items = spark.createDataFrame([(1, item), (2, prose(rng, 30)), (3, "too short"), (4, None), (1000, item[:-9])], "item_id long, text string")
    texts = [f"{prose(rng, 30)} {item} {prose(rng, 9)}", f"{prose(rng, 20)}. {other} {prose(rng, 20)}", mixed, prose(rng, 60), None, "", "too short", item.upper()]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, at int")
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in matches(docs, items).collect()}
    assert got[0, 1] and (1, 1) in got and not got[1, 1] and not any(k[0] in (3, 4, 5, 6) for k in got)
    assert {r["doc_id"] for r in clean(docs, items).collect()} >= {3, 4, 5, 6}
    assert clean(docs, items).columns == docs.columns
    assert matches(empty, items).count() == 0 and matches(docs, items.limit(0)).count() == 0


def test_licences(spark, empty):
    from waveloom.llm.licenses import scanned

    rng = random.Random(3)
    rows = [(1, "a/b", "Released under the MIT License."), (2, "a/b/c", prose(rng, 30)), (3, "a", f"{prose(rng, 30)}\nLicensed under the Apache License, Version 2.0.\n{prose(rng, 5)}")]
    rows += [(4, "a", prose(rng, 9)), (5, None, None), (6, "x", ""), (7, "", "This work is licensed under the GNU General Public License, version 3."), (8, "x/y", "general public source code terms of the work"), (2, "a/b/c", "")]
    got = {(r["doc_id"], r["path"]): (r["licence"], r["how"], r["licensed_by"]) for r in scanned(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[1, "a/b"] == ("mit", "own", "a/b") and got[2, "a/b/c"] == ("mit", "inherited", "a/b")
    assert got[3, "a"] == ("apache-2.0", "own", "a") and got[4, "a"] == ("gpl-3.0", "inherited", "") and got[8, "x/y"][1] == "inherited"
    assert scanned(empty.withColumn("path", F.lit("p"))).count() == 0


@pytest.mark.parametrize("size", [200, 4000])
def test_licence_scores_at_two_sizes(spark, size):
    from waveloom.llm.licenses import scanned

    rng = random.Random(13)
    notice, words = "This project is released under the MIT License.", lambda t: re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower())
    texts = [("This project is here. " if k % 2 else "") + prose(rng, 20) + (f"\n{notice}" if k % 50 == 3 else "\nAll rights reserved." if k % 25 == 7 else "") for k in range(size)]
    templates = {"mit": "Released under the MIT License", "proprietary": "All rights reserved"}
    rarity = lambda w: np.log((3 + size) / (1 + sum(w in words(t) for t in [*texts, *templates.values()]))) + 1
    a, b = ({w: rarity(w) for w in words(t)} for t in (notice, templates["mit"]))
    want = sum(a[w] * b[w] for w in b) / np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    table = spark.createDataFrame([(k, "p", t) for k, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in scanned(table, templates=templates).collect() if r["how"] == "own"}
    assert sorted(got) == [k for k in range(size) if k % 50 == 3 or k % 25 == 7]
    assert all(abs(r["score"] - (want if k % 50 == 3 else 1)) < 1e-5 for k, r in got.items())
    assert {r["doc_id"]: r["licence"] for r in scanned(table).collect() if r["how"] == "own"} == {k: r["licence"] for k, r in got.items()}


def test_simple8b_round_trip():
    from waveloom.llm.tokens import decode, encode, pack, unpack

    rng = np.random.default_rng(0)
    for top in (1, 2, 9, 50257, 1 << 31, 1 << 63):
        parts = [rng.integers(0, top, n, dtype=np.uint64) for n in (0, 1, 5, 239, 240, 241, 3000)] + [np.zeros(700, np.uint64)]
        ids, bounds = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
        words, offsets, first = encode(ids, bounds)
        lengths = np.concatenate([np.r_[np.full((len(p) - 1) // 240, 240), len(p) - 240 * ((len(p) - 1) // 240)] for p in parts if len(p)]).astype(np.int64)
        assert np.array_equal(decode(words, offsets, lengths), ids)
        got, at = unpack(pack(ids, bounds))
        assert np.array_equal(got, ids) and np.array_equal(at, bounds)
    assert len(encode(np.zeros(240, np.uint64), np.array([0, 240]))[0]) == 1


def test_token_ids(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from waveloom.llm.tokens import round_trip

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, start, want = Tokenizer.from_file(path), 0, {}
    tokenizer.encode_special_tokens = True
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in round_trip(docs, path).collect()} == want
    assert round_trip(empty, path).count() == 0


def test_token_ids_of_the_library(rows):
    import inspect

    import public_tokenizers
    from tokenizers import Tokenizer

    from waveloom.llm.tokens import PieceEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [t or "" for _, t, _ in rows] + ["a<|endoftext|>b c"] + [f"a{c}1{c}!{c} b" for c in "\u088f\ua7ce\U00010940"]
    encoder = PieceEncoder(path, special=True) if "special" in inspect.signature(PieceEncoder).parameters else PieceEncoder(path)
    ids, bounds = encoder.encode(texts)
    tokenizer = Tokenizer.from_file(path)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("group", [500, 1 << 20])
def test_repeated_passages(docs, rows, empty, group):
    from waveloom.llm.suffix import repeated

    seen, want = set(), {}
    for i, t, _ in rows:
        b = (t or "").encode()
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        gone = np.zeros(len(b), bool)
        for k, s in enumerate(own):
            if s in seen:
                gone[k : k + 50] = True
        seen.update(own)
        want[i] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated(docs, group=group).collect()} == want
    assert repeated(empty).count() == 0


def shuffled(spark, action):
    """What action returns, and the bytes that its stages write to shuffles."""
    sc, gateway = spark._jsc.sc(), spark.sparkContext._gateway

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    before = max(stages(), default=-1)
    return action(), sum(size for k, size in stages().items() if k > before)


def test_repeated_passages_move_little(spark):
    from waveloom.llm.suffix import repeated

    rng = random.Random(6)
    shared = [prose(rng, 12) for _ in range(300)]
    texts = [" ".join(rng.choice(shared)[rng.randrange(40) :] if rng.random() < 0.3 else prose(rng, 10) for _ in range(rng.randrange(5, 60))) for _ in range(600)]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        own = [t[k : k + 50] for k in range(len(t) - 49)]
        gone = np.zeros(len(t), bool)
        for k, s in enumerate(own):
            if s in seen:
                gone[k : k + 50] = True
        seen.update(own)
        want[i * 7] = int(gone.sum())
    docs = spark.createDataFrame([(i * 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got, moved = shuffled(spark, lambda: {r["doc_id"]: r["n_removed"] for r in repeated(docs, group=1 << 19).collect()})
    assert got == want and sum(want.values()) > 100_000
    assert moved < 3.2 * sum(map(len, texts))


def test_hashes_travel_as_steps():
    from waveloom.llm.suffix import _stepped, _unstepped

    for h in ([0], [2**64 - 1], [0, 0, 1, 2**48 - 1, 2**48, 2**63, 2**64 - 1, 2**64 - 1], np.sort(np.random.default_rng(1).integers(0, 2**64, 5000, np.uint64))):
        h = np.array(h, np.uint64)
        assert (_unstepped(_stepped(h)) == h).all()


def reach(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_simhash(docs, rows, empty):
    import xxhash

    from waveloom.llm.simhash import near_duplicates

    def print_of(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fp = [print_of(t) for _, t, _ in rows]
    label = reach(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert got == {i: (f"{fp[k]:016x}", rows[label[k]][0]) for k, (i, _, _) in enumerate(rows)}
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("split", [3, 20_000])
def test_trie_links(spark, split):
    from waveloom.llm.common import components
    from waveloom.llm.simhash import linked

    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:40]:
        for _ in range(4):
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                v ^= 1 << b
            values.append(v)
    values = sorted(set(values))
    label = reach(len(values), [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 4])
    table = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, k) for k, v in enumerate(values)], "fp long, rep long")
    found = {r["node"]: r["component"] for r in components(linked(table, split=split)).collect()}
    assert [found.get(k, k) for k in range(len(values))] == label


@pytest.mark.parametrize("split", [20_000, 0])
def test_trie_links_on_block_borders(spark, split):
    from itertools import combinations

    from waveloom.llm.common import components
    from waveloom.llm.simhash import linked

    rng = random.Random(14)
    # borders of the five blocks of 64 bits, and of the five blocks of the 51 bits after the first
    borders = [0, 12, 13, 23, 24, 25, 26, 33, 34, 38, 39, 43, 44, 51, 52, 53, 54, 63]
    patterns = [sum(1 << (63 - b) for b in four) for four in combinations(borders, 4)]
    values = [v for p, x in zip(patterns, [rng.getrandbits(64) for _ in patterns], strict=True) for v in (x, x ^ p)]
    table = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, k) for k, v in enumerate(values)], "fp long, rep long")
    found = {r["node"]: r["component"] for r in components(linked(table, split=split)).collect()}
    assert [k for k in range(len(values)) if found.get(k) != k - k % 2] == []


def test_components_of_a_chain(spark):
    from waveloom.llm.common import components

    ids = list(range(200))
    random.Random(6).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (500, 501), (9, 9)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == dict.fromkeys(range(200), 0) | {500: 500, 501: 500}
    assert components(edges.limit(0)).count() == 0


def test_quality_and_toxicity(spark, empty):
    from waveloom.llm import quality, toxicity

    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        good, bad = rng.random() < 0.7, rng.random() < 0.3
        words = prose(rng, 40).split()
        if not good:
            words = [w + "$$$" for w in words]
        if bad:
            words[rng.randrange(40)] = "scoundrel"
        rows.append((i, ". ".join(" ".join(words[k : k + 8]) for k in range(0, 40, 8)) + ".", "x"))
        labels.append((i, int(good), int(bad)))
    rows += [(1000 + k, t, "x") for k, t in enumerate(AWKWARD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y string")
    marks = spark.createDataFrame([*labels, (1, None, None), (None, 1, 1), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    got = quality.scored(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r["quality_score"] <= 1 for r in got) and got[0]["y"] == "x"
    out = [r for r in got if r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["quality_pred"] == truth[r["doc_id"]][0] for r in out]) > 0.95
    got = toxicity.scored(docs, marks).collect()
    out = [r for r in got if r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["toxic_pred"] == truth[r["doc_id"]][1] for r in out]) > 0.95
    text = dict((i, t) for i, t, _ in rows)
    for r in out:
        if r["toxic_pred"] and truth[r["doc_id"]][1]:
            assert "scoundrel" in text[r["doc_id"]].encode()[r["worst_start"] : r["worst_end"]].decode()
    for m in (quality, toxicity):
        assert m.scored(docs, marks.limit(0)).count() == len(rows) and m.scored(empty.select("doc_id", "text"), marks).count() == 0


def test_mixing(docs, rows, empty):
    from waveloom.llm.mixing import emitted, mixed

    got = mixed(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    weight = dict(zip([*sorted(s for s in sizes if s is not None), None], [5, 2, 1, 5], strict=False))
    total, held = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in held)) / sum(w for s, w in weight.items() if s not in held)
        more = {s for s in sizes if s not in held and weight[s] * level > 3 * sizes[s]}
        if not more:
            break
        held |= more
    for r in got:
        assert r["target"] == pytest.approx(3 * sizes[r["source"]] if r["source"] in held else weight[r["source"]] * level)
        assert r["copies"] <= 3 and r["source_size"] == sizes[r["source"]]
    assert emitted(docs).columns == docs.columns and emitted(docs).count() == sum(r["copies"] for r in got)
    assert mixed(empty).count() == 0


def test_embeddings(spark):
    from waveloom.llm.embeddings import near_duplicates

    rng = np.random.default_rng(8)
    base = rng.normal(size=(700, 64))
    near = [base[k] / np.linalg.norm(base[k]) + rng.normal(size=64) / 8 * s for k in range(0, 700, 3) for s in (0.2, 0.45)]
    vecs = np.concatenate([base, near, base[:5], base[:2]]).astype(np.float32)
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [1.0, None], [float("inf")] * 64, [1.0, 2.0], [2.0, 4.0], [1e300] * 64, [1e-300] * 64]
    rows = [(k, [float(x) for x in v], 0) for k, v in enumerate(vecs)] + [(5000 + k, v, 0) for k, v in enumerate(odd)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int")
    unit = vecs.astype(float) / np.linalg.norm(vecs.astype(float), axis=1)[:, None]
    want = (unit @ unit.T >= 0.9) & ~np.eye(len(unit), dtype=bool)
    got = {r["vec_id"]: r for r in near_duplicates(table, cell=60, block=40).collect()}
    assert len(got) == len(rows)
    links = np.array([got[k]["n_links"] for k in range(len(vecs))])
    assert (links <= want.sum(1)).all() and links.sum() >= 0.99 * want.sum()
    assert got[5006]["n_links"] == 1 and got[5007]["component_id"] == 5006 and got[5008]["n_links"] == 1
    assert all(got[5000 + k]["n_links"] == 0 for k in range(6)) and got[5009]["component_id"] == 5008
    assert near_duplicates(table.limit(0)).count() == 0


def _linked(rng, n, dims):
    """Unit vectors, three partners each at cosine 0.901, and which are linked."""
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    base = np.repeat(unit(rng.normal(size=(n, dims))), 3, 0)
    side = unit((x := rng.normal(size=base.shape)) - (x * base).sum(1)[:, None] * base)
    vecs = np.concatenate([base[::3], 0.901 * base + np.sqrt(1 - 0.901**2) * side])
    return vecs, (vecs @ vecs.T >= 0.9) & ~np.eye(len(vecs), dtype=bool)


def test_embeddings_lose_no_link(spark):
    from waveloom.llm import embeddings

    vecs, want = _linked(np.random.default_rng(18), 1000, 16)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    for block in (2000, 30):
        got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(table, margin=None, cell=40, block=block).collect()}
        assert [got[k] for k in range(len(vecs))] == want.sum(1).tolist()


@pytest.mark.parametrize("dims", [8, 16, 64])
def test_embeddings_recall_at_production_margin(dims):
    """Links at the very threshold that the default margin finds; and what cells spare."""
    from waveloom.llm.embeddings import MARGIN, _visits, fit_centres

    vecs, want = _linked(np.random.default_rng(dims), 4000, dims)
    home, row, cell = _visits(vecs, fit_centres(vecs, 200), 0.9, MARGIN)
    guest = np.zeros((len(vecs), 200), bool)
    guest[row, cell] = True
    i, j = np.nonzero(want)
    met = (home[i] == home[j]) | guest[i, home[j]] | guest[j, home[i]]
    assert met.mean() >= 0.995
    members = np.bincount(home, minlength=200)
    assert (guest * members).sum() + (members * members).sum() / 2 < 0.3 * len(vecs) ** 2 / 2


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name == "tokens":
            assert out.count() == docs.count()
            break
        assert out.columns == docs.columns
        docs, kept = spark.read.parquet(_written(out, tmp_path / name)), name
    assert kept == "mix"


def _written(df, path):
    df.write.parquet(str(path))
    return str(path)


def _template_windows(text, names, plain, window, literal):
    """Windows of a text by plain Python: (first word, key, slots)."""
    from waveloom.llm.decontam import UNITS

    words, kinds = [w.strip("".join(chr(k) for k in range(33, 127) if not chr(k).isalnum())) for w in text.split()], []
    for k, w in enumerate(words):
        low = w.lower()
        number = sum(c.isdigit() for c in w) * 2 >= len(w) and any(c.isdigit() for c in w)
        capital = len(w) > 1 and w[0].isupper() and not w[1].isupper()
        kind = "N" if number else "U" if low in UNITS and k and kinds[-1] == "N" else "P" if low in names or (capital and low not in plain) else ""
        kinds.append(kind)
    for a in range(len(words) - window + 1):
        own, kind = [w.lower() for w in words[a : a + window]], kinds[a : a + window]
        if sum(not k for k in kind) >= literal:
            yield a, ("t", *(f"<{k}>" if k else w for w, k in zip(own, kind, strict=True))), [w for w, k in zip(own, kind, strict=True) if k]
        else:
            yield a, ("w", *own), []
    if 5 <= len(words) < window:
        yield 0, ("s", *map(str.lower, words)), []


def test_decontamination_equals_brute_force(spark):
    from waveloom.llm.decontam import LITERAL, RUN, SHARE, WINDOW, matches

    rng = random.Random(31)
    vocabulary = "has gives apples pears to the market and sells each for a price of how many are left what is total sum after buying more".split()
    names = "Alice Bob Carol Dora Emil Franz".split()

    def sentence():
        out = [rng.choice([rng.choice(names), rng.choice(vocabulary), str(rng.randint(2, 99)), rng.choice(vocabulary), "5 km"]) for _ in range(rng.randint(3, 14))]
        return " ".join([out[0][0].upper() + out[0][1:], *out[1:]]) + "."

    items = [(k, " ".join(sentence() for _ in range(rng.randint(1, 3)))) for k in range(40)]
    turn = lambda t: "".join(rng.choice("123456789") if c.isdigit() and rng.random() < 0.6 else c for c in t).replace("Alice", "Zoe").replace("Emil", "Udo")
    docs = [(k, " ".join([sentence(), rng.choice([str, str.lower, str.upper, turn, str.title])(rng.choice(items)[1]), sentence()])) for k in range(160)] + [(1000 + k, " ".join(sentence() for _ in range(4))) for k in range(40)]
    inside, lower, seen = {}, {}, set()
    for _, t in items:
        opens = True
        for w in t.split():
            bare = w.strip(".")
            capital = len(bare) > 1 and bare[0].isupper() and not bare[1].isupper()
            seen.add(bare.lower())
            inside[bare.lower()] = inside.get(bare.lower(), 0) + (capital and not opens)
            lower[bare.lower()] = lower.get(bare.lower(), 0) + (not capital)
            opens = w.endswith(".")
    called = {w for w in seen if inside[w] > lower[w] or not lower[w]}
    want = {}
    own = {i: list(_template_windows(t, called, seen - called, WINDOW, LITERAL)) for i, t in items}
    short = {i: t.lower().replace(".", "").split() for i, t in items if 5 <= len(t.split()) < WINDOW}
    for d, t in docs:
        theirs, words = {}, [w.strip(".").lower() for w in t.split()]
        for at, key, slots in _template_windows(t, called, seen - called, WINDOW, LITERAL):
            theirs.setdefault(key, []).append((at, slots))
        for i, wins in own.items():
            lines = {}
            for at, key, slots in wins:
                there = [(a, []) for a in range(len(words)) if key[0] == "s" and words[a : a + len(short[i])] == short[i]] if key[0] == "s" else theirs.get(key, [])
                for a, other in there:
                    lines.setdefault(a - at, []).append((at, list(zip(slots, other, strict=True))))
            matched, exact = set(), True
            for found in lines.values():
                pairs = {p for _, ps in found for p in ps}
                bad = {p for p in pairs for q in pairs if (p[0] == q[0]) != (p[1] == q[1])}
                for at, ps in found:
                    if not bad & set(ps):
                        matched.add(at)
                        exact &= all(a == b for a, b in ps)
            if matched and len(matched) >= min(RUN, int(np.ceil(len(wins) * SHARE))):
                want[d, i] = (len(matched), exact)
    got = matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) > 100 and any(not x[1] for x in want.values())
    assert {(r["doc_id"], r["item_id"]): (r["n_matched"], r["exact"]) for r in got} == want


def test_decontamination_of_cases_names_and_short_items(spark):
    from waveloom.llm.decontam import clean, matches

    items = [(1, "Alice has 3 apples. Alice buys 4 more apples at the shop. How many apples does Alice have now?"), (2, "17 + 25 = 42, 19 + 23 = 42, 11 + 31 = 42"), (3, "name the largest inner moon"), (4, "Der Hund jagt die Katze durch den Garten und das Haus am Abend")]
    docs = [(1, "Bob has 7 apples. Bob buys 9 more apples at the shop. How many apples does Bob have now?"), (2, items[0][1].lower()), (3, items[0][1].upper()), (4, "sums: " + items[1][1]), (5, "17 + 26 = 43, 19 + 24 = 43, 11 + 32 = 43"), (6, "now Name the largest inner moon please"), (7, items[3][1].lower()), (8, "The shop has apples and many of them are red, says the woman at the door")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["exact"]) for r in matches(docs, items).collect()} == {(1, 1, False), (2, 1, True), (3, 1, True), (4, 2, True), (6, 3, True), (7, 4, True)}
    assert {r["doc_id"] for r in clean(docs, items).collect()} == {5, 8}


def test_licence_headers_files_and_identifiers(spark):
    from waveloom.llm.licenses import TEMPLATES, scanned

    wrap = lambda t, n, mark: "\n".join(mark + " ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    mit, apache, gpl = TEMPLATES["mit"][1], TEMPLATES["apache-2.0"][1], TEMPLATES["gpl-3.0"][1]
    code = "\n\n" + "\n".join(f"value_{k} = compute(other_{k}, {k})" for k in range(40))
    rows = [
        (1, "a", "MIT License\n\nCopyright (c) 2021 Somebody\n\n" + wrap(mit, 12, "")),
        (2, "a/src", wrap(apache, 9, " * ") + code),
        (3, "a/src", "# SPDX-License-Identifier: BSD-3-Clause" + code),
        (4, "a/src/deep", code),
        (5, "b", "// " + "SPDX-License-Identifier: GPL-2.0-or-later" + code),
        (6, "b", wrap(gpl, 10, "// ") + code),
        (7, "c", "The software team met and all of them had a good time without any trouble."),
    ]
    got = {r["doc_id"]: (r["licence"], r["how"], r["licensed_by"]) for r in scanned(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("mit", "own", "a"), 2: ("apache-2.0", "own", "a/src"), 3: ("bsd-3-clause", "own", "a/src"), 4: ("mit", "inherited", "a"), 5: ("gpl-2.0", "own", "b"), 6: ("gpl-3.0", "own", "b"), 7: (None, "none", None)}


def test_pii_terms_equal_brute_force(spark):
    """Repeated rows count each, terms far from a mention count, and all their places are marked."""
    from waveloom.llm.pii import GENERAL, REMOVE, SUPPORT, sanitised

    rng = random.Random(8)
    mails = [f"user{k}@mail{k % 3}.org" for k in range(9)]
    rows = []
    for k in range(120):
        words = [rng.choice(["alpha", "beta", "gamma", "Delta", "epsilon"]) for _ in range(rng.randint(3, 60))]
        if k % 3 == 0:
            m = rng.randrange(len(mails))
            words.insert(rng.randrange(len(words)), mails[m])
            words.insert(rng.randrange(len(words)), f"Codename{'abcdefghi'[m]}" if rng.random() < 0.9 else "else")
            words += ["filler"] * 40 + [f"codename{'abcdefghi'[m]}"]
        rows.append((k if k % 10 else None, " ".join(words)))
    rows += [rows[3]] * 3 + [(500, None), (501, ""), (502, " ".join(str(k) + "." for k in range(10_000)) + " 10.1.2.3 +1 555 123 4567")]
    term = r"(?<!\w)[^\W\d_]{3,}(?!\w)"
    of = lambda t: {w.lower() for w in re.findall(term, t)}
    held = [{(k, t[s:e].lower()) for s, k, e in base(t or "")} for _, t in rows]
    kinds = ("email", "ip", "card", "phone", "term")
    met, holders, both = Counter(), Counter(), Counter()
    for (_, t), es in zip(rows, held, strict=True):
        terms = of(t or "")
        met.update(terms)
        holders.update(es)
        both.update((e, w) for e in es for w in terms)
    share = {(e, w): np.log(len(rows) * n / (met[w] * holders[e])) / np.log(len(rows) / holders[e]) for (e, w), n in both.items() if n >= SUPPORT}
    want = []
    for (i, t), es in zip(rows, held, strict=True):
        t = t or ""
        best = {}
        for (e, w), x in share.items():
            if e in es and x >= GENERAL:
                best[w] = max(x, best.get(w, 0))
        plain = base(t)
        places = [(m.start(), 4, m.end()) for m in re.finditer(term, t) if m[0].lower() in best and not any(s < m.end() and e > m.start() for s, _, e in plain)]
        want.append((i, ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(plain + places)), sum(best[t[s:e].lower()] >= REMOVE for s, _, e in places)))
    from waveloom.llm.pii import joined

    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sanitised(table, texts=False).select("doc_id", joined(F.col("spans")).alias("s"), F.expr("size(filter(terms, x -> x.removed))").alias("removed")).collect()
    assert any("term" in w[1] for w in want)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
