"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

from __future__ import annotations

import datetime as dt
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from compare import both
from conftest import SF
from tidemark.llm import _bpe, _tiles, balancing, bitplanes, chaining, chunked_bpe, digest, language_id, line_frequency, pseudonyms, queries, simhash, style_tree
from tidemark.llm._dom import identify, parse, visible_text


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    for sf in (SF, "/root/testdata/sf0.01"):
        ours, theirs = both(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf)
        assert ours == theirs


def test_frequent_lines_go_and_depleted_documents_too(spark):
    rows = [(k, f"Share  this\n{'own line %d is longer than that' % k if k % 3 else 'x'}\n\n", "h") for k in range(40)] + [(99, "share this\nother host", "g")]
    out = {r.doc_id: r for r in line_frequency.filter_frequent_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[1].text == "own line 1 is longer than that\n\n" and out[1].kept and out[1].n_removed == 1
    assert not out[0].kept and out[99].kept and out[99].n_removed == 0


def test_joined_lines_give_the_same(spark, docs, monkeypatch):
    one = sorted(map(repr, line_frequency.filter_frequent_lines(docs, min_docs=2).collect()))
    monkeypatch.setattr(line_frequency, "BROADCAST_ENTRIES", -1)
    assert sorted(map(repr, line_frequency.filter_frequent_lines(docs, min_docs=2).collect())) == one


def test_blanks_of_any_kind_are_not_kept(spark):
    rows = [(k, t, "h") for k, t in enumerate(("\t", "\r", "  \n\t", "\f \x0b", "\u00a0", "x\t"))]
    out = {r.doc_id: r.kept for r in line_frequency.filter_frequent_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out == {0: False, 1: False, 2: False, 3: False, 4: True, 5: True}


def test_a_line_in_many_documents_is_frequent_however_large_the_host(spark, monkeypatch):
    monkeypatch.setattr(line_frequency, "MOST_DOCS", 15)
    rows = [(k, (f"own {k}\nlicence line" if k < 16 else f"own {k}\nrarer line" if k < 30 else f"own {k}"), "h") for k in range(3000)]
    out = line_frequency.filter_frequent_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in out if r.n_removed} == set(range(16))


def _sentences(n, seed):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(30000)}" for _ in range(n)]


def test_passages(spark):
    shared, rnd = _sentences(80, 1), random.Random(2)
    fuzzy = [w if k % 19 else f"changed{k}" for k, w in enumerate(shared)]
    docs = {1: _sentences(60, 3) + shared + _sentences(50, 4), 2: _sentences(30, 5) + fuzzy + _sentences(20, 6), 3: _sentences(200, 7), 4: shared[:20] + _sentences(90, 8), 5: None}
    docs[6] = docs[1]
    rows = [(k, v and ", ".join(v)) for k, v in docs.items()]
    rnd.shuffle(rows)
    out = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.ref_doc_id): r for r in out}
    assert set(got) == {(2, 1), (6, 1)}
    text = ", ".join(docs[2])
    found = text[got[2, 1].start_char : got[2, 1].end_char].split(", ")
    assert len(found) >= 76 and set(found) <= set(fuzzy)
    assert got[6, 1].start_char == 0 and got[6, 1].end_char == len(", ".join(docs[1])) and got[6, 1].identity == 1


def test_chains_are_in_order():
    rnd = np.random.default_rng(3)
    for _ in range(50):
        p = np.sort(rnd.choice(300, 25, replace=False))
        q = rnd.integers(0, 300, 25)
        for c in chaining.chains(p, q):
            assert (np.diff(c[:, 0]) > 0).all() and (np.diff(c[:, 1]) > 0).all()
            assert (c[:-1, 0] + c[:-1, 2] <= c[1:, 0]).all() and (c[:-1, 1] + c[:-1, 2] <= c[1:, 1]).all()


def test_query_passages_by_brute_force(spark, docs, texts):
    """Exact runs of 50 equal words that two documents share are all found, by their later document."""
    words = {k: re.findall(rb"[a-z0-9\x80-\xff]+", t.encode().lower()) for k, t in texts.items()}
    first, wanted = {}, set()
    for k in sorted(words):
        for i in range(len(words[k]) - 49):
            run = tuple(words[k][i : i + 50])
            if first.setdefault(run, k) != k:
                wanted.add(k)
    found = {r.doc_id for r in chaining.op2_collinear_chains(spark, SF).select("doc_id").distinct().collect()}
    assert wanted <= found


def test_ids_leave_in_small_batches(spark, monkeypatch):
    """However small the batches that a task handles, ids are those of the whole texts."""
    monkeypatch.setattr(chunked_bpe, "BATCH", 500)
    shared = " ".join(_sentences(600, 71))
    rows = [(k, f"{shared} {k}" if k % 2 else " ".join(_sentences(50, 9000 + k))) for k in range(24)] + [(24, None), (25, "")]
    out = {r.doc_id: r.ids for r in chunked_bpe.encode_chunked(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert out == {k: None if t is None else _bpe.encode(t).tolist() for k, t in rows}


def test_feistel_is_a_permutation():
    for n in (1, 2, 7, 100, 365):
        f = pseudonyms.Feistel(b"k", "t", n)
        image = [f.walk(x) for x in range(n)]
        assert sorted(image) == list(range(n)) and [f.walk(y, back=True) for y in image] == list(range(n))


KEY = b"a key for tests"


def _plain_values(text):
    """Values that are plain to see: addresses, cards in fours, ISO dates, IPs with four parts, by expressions of their own."""
    mails = re.findall(r"(?<![\w.%+-])[a-z]+[a-z.]*@[a-z]+\.[a-z]{2,4}\b", text)
    cards = [c for c in re.findall(r"(?<![\d -])(?:\d{4} ){3}\d{4}(?![\d -])", text) if sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(c.replace(" ", "")))) % 10 == 0]
    ips = [i for i in re.findall(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])", text) if all(int(p) < 256 and str(int(p)) == p for p in i.split("."))]
    return mails, cards, ips


def test_pseudonyms(spark, docs, texts):
    spark.conf.set(pseudonyms.KEY_SETTING, KEY.hex())
    out = {r.doc_id: r for r in pseudonyms.op3_feistel_pseudonyms(spark, SF).collect()}
    spark.conf.unset(pseudonyms.KEY_SETTING)
    brute = pseudonyms.Pseudonymiser(KEY)
    assert {k: tuple(r)[1:] for k, r in out.items()} == {k: brute.replace(t) for k, t in texts.items()}
    linked, seen = {}, 0
    for k, t in texts.items():  # by other means: formats stay, values change, equal ones alike and others not
        old, new = _plain_values(t), _plain_values(out[k].text)
        assert re.sub("[0-9]+", "9", re.sub("[a-z]", "a", t)) == re.sub("[0-9]+", "9", re.sub("[a-z]", "a", out[k].text))
        for kind, (a, b) in enumerate(zip(old, new)):
            assert len(a) == len(b)
            for x, y in zip(a, b):
                assert x not in out[k].text and linked.setdefault((kind, x), y) == y
                seen += 1
    assert seen > 3 and len(set(linked.values())) == len(linked)
    line = "mail a.b@ex-mple.org card 4111 1111 1111 1111 ssn 123-45-6789 date 2024-02-29 or 29.02.2024 ip 8.8.8.8 phone (415) 555-2671 iban DE89 3704 0044 0532 0130 00 pi 3.14159 no 4111 1111 1111 1112 bad 2024-02-30"
    new, n = brute.replace(line)
    assert n == 8 and new.endswith("no 4111 1111 1111 1112 bad 2024-02-30") and "pi 3.14159" in new
    assert pseudonyms.luhn(re.sub(r"\D", "", re.search(r"card ([\d ]+) ssn", new)[1])) and pseudonyms.iban_rest(re.search(r"iban ([A-Z0-9 ]+) pi", new)[1].replace(" ", "")) == 1
    iso, dotted = re.search(r"date (\S+) or (\S+)", new).groups()
    assert dt.date.fromisoformat(iso) == dt.datetime.strptime(dotted, "%d.%m.%Y").date()  # equal dates stay linked
    assert pseudonyms.Pseudonymiser(KEY, back=True).replace(new)[0] == line
    assert brute.replace("4111-1111-1111-1111")[0].replace("-", " ") in new


def test_one_value_has_one_pseudonym_in_any_spelling():
    worker, back = pseudonyms.Pseudonymiser(KEY), pseudonyms.Pseudonymiser(KEY, back=True)
    read = {"%Y-%m-%d": "{0:%Y-%m-%d}", "%d/%m/%Y": "{0:%d/%m/%Y}", "%d.%m.%Y": "{0:%d.%m.%Y}", "%m/%d/%Y": "{0:%m/%d/%Y}", "%Y/%m/%d": "{0:%Y/%m/%d}"}
    for k in range(0, 73049, 283):
        day, images = dt.date(1900, 1, 1) + dt.timedelta(k), set()
        for parse_, show in read.items():
            if parse_ == "%d/%m/%Y" and day.day <= 12:
                continue  # reads as month first
            text = show.format(day)
            new = worker.replace(text)[0]
            images.add(dt.datetime.strptime(new, parse_).date())
            assert back.replace(new)[0] == text
        assert len(images) == 1
    digits = lambda t: re.sub(r"\D", "", t)
    for same in (["+420 123456789", "+420123456789", "+420 123 456 789"], ["+353 1 2345678", "+35312345678"], ["+14155552671", "+1 (415) 555-2671", "+1-415-555-2671"], ["+44 20 7946 0958", "+442079460958"]):
        new = [worker.replace(t) for t in same]
        assert all(n == 1 for _, n in new) and len({digits(t) for t, _ in new}) == 1 and digits(new[0][0]) != digits(same[0])
        assert [back.replace(t)[0] for t, _ in new] == same
    assert digits(worker.replace("(415) 555-2671")[0]) == digits(worker.replace("+14155552671")[0])[1:]
    german = [worker.replace(t)[0] for t in ("+49 (0)30 1234567", "+49 30 1234567")]
    assert german[0].replace("(0)", "") == german[1] and "(0)" in german[0]
    mixed, plain = worker.replace("Bob@Example.com")[0], worker.replace("bob@example.com")[0]
    assert mixed.lower() == plain and mixed != plain and back.replace(mixed)[0] == "Bob@Example.com"


def test_a_session_without_a_key_has_one_of_its_own(spark):
    one = pseudonyms.session_key(spark)
    assert len(one) == 32 and one == pseudonyms.session_key(spark)


@pytest.mark.parametrize("chunk,rows", [(1 << 20, 8192), (23, 17)])
def test_near_duplicates_by_brute_force(spark, texts, monkeypatch, chunk, rows):
    monkeypatch.setattr(_tiles, "CHUNK", chunk)
    monkeypatch.setattr(_tiles, "ROWS", rows)
    ids = sorted(texts)
    prints, n = simhash.fingerprints([texts[k] for k in ids])
    root, links = list(range(len(ids))), [0] * len(ids)

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        near = (np.bitwise_count(prints ^ prints[i]).sum(1) <= 56) & (n > 0) & (n[i] > 0)
        links[i] = max(0, int(near.sum()) - 1)
        for j in np.flatnonzero(near[:i]):
            a, b = up(i), up(int(j))
            root[max(a, b)] = min(a, b)
    out = {r.doc_id: r for r in simhash.op4_simhash(spark, SF).collect()}
    assert {k: (r.group_id, r.n_links) for k, r in out.items()} == {k: (ids[up(i)], links[i]) for i, k in enumerate(ids)}
    assert all(r.keep == (r.group_id == k) for k, r in out.items()) and max(links) > 1


def test_tiles_pass_over_sizes_that_are_too_far():
    rnd = np.random.default_rng(8)
    import pandas as pd

    words = rnd.integers(-(1 << 62), 1 << 62, (3000, 2))
    words[1500:] = words[:1500] ^ (1 << rnd.integers(0, 60, (1500, 2)))
    size = np.bitwise_count(words.view(np.uint64)).sum(1).astype(int)
    frame = pd.DataFrame({"id": np.arange(3000), "copies": 1, "size": size, "a": words[:, 0], "b": words[:, 1]})
    one = _tiles.Side(frame, ["a", "b"], [])
    got = {(one.ids[x], one.ids[y]) for p, q in _tiles.near_in_tiles(one, one, 4, True, (0, 1), 4, tile=16, wide=64) for x, y in zip(p, q)}
    bits = words.view(np.uint64)
    wanted = {(i, j) for i in range(3000) for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]).sum(1) <= 4) if i != j}
    assert {frozenset(x) for x in got} == {frozenset(x) for x in wanted} and 2 * len(got) == len(wanted)


def test_near_parts_find_what_all_pairs_do(monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 63, (300, 4), dtype=np.uint64) << np.uint64(1)
    near = np.repeat(prints[:60], 10, axis=0)
    for row in near:  # up to 70 bits away, so on both sides of the radius; copies of a word too
        for bit in rng.choice(256, rng.integers(1, 71), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    prints = np.unique(np.concatenate((prints, near)), axis=0)
    table = pd.DataFrame(prints.view(np.int64), columns=simhash.HASHES)
    table = table.assign(id=rng.permutation(len(prints)), copies=1, size=np.bitwise_count(prints).sum(1))
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2)
    want = {frozenset((table.id[i], table.id[j])) for i, j in zip(*np.nonzero(np.triu(apart <= 56, 1)))}
    assert len(want) > 500
    whole, low, high = (_tiles.Side(t, simhash.HASHES, []) for t in (table, table[table.id < 400], table[table.id >= 400]))
    for pays in (True, False):
        monkeypatch.setattr(simhash, "parts_pay", lambda *_, pays=pays: pays)
        found = [frozenset((one.ids[x], two.ids[y])) for one, two, same in ((low, whole, True), (high, whole, True)) for p, q in simhash.near_pairs(one, two, 56, same) for x, y in zip(p, q)]
        assert len(found) == len(set(found)) and set(found) == want
        found = [frozenset((low.ids[x], high.ids[y])) for p, q in simhash.near_pairs(low, high, 56, False) for x, y in zip(p, q)]
        assert len(found) == len(set(found)) and set(found) == {pair for pair in want if min(pair) < 400 <= max(pair)}


def test_large_tables_are_compared_by_parts():
    import pandas as pd

    prints = np.random.default_rng(6).integers(0, 1 << 63, (250_000, 4), dtype=np.uint64)
    table = pd.DataFrame(prints.view(np.int64), columns=simhash.HASHES).assign(id=np.arange(len(prints)), copies=1, size=128)
    whole, some = (_tiles.Side(t, simhash.HASHES, []) for t in (table, table[:100_000]))
    assert _tiles.parts_pay(some, whole, 56, True) and not _tiles.parts_pay(_tiles.Side(table[:500], simhash.HASHES, []), whole, 56, True)
    alike = _tiles.Side(table[:20_000].assign(**{h: 7 for h in simhash.HASHES}), simhash.HASHES, [])
    assert not _tiles.parts_pay(alike, alike, 56, True)  # where no part tells rows apart, tiles are less work


def test_fingerprint_bits():
    text = "one two three two one"
    doc, hashed = simhash.features([text])
    assert len(hashed) == 3 + 4
    lone, _ = simhash.fingerprints([text])
    many, _ = simhash.fingerprints(["x", text, ""])
    assert (lone[0] == many[1]).all()


@pytest.mark.parametrize("chunk,rows", [(1 << 20, 8192), (23, 17)])
def test_digests_by_brute_force(spark, texts, monkeypatch, chunk, rows):
    monkeypatch.setattr(_tiles, "CHUNK", chunk)
    monkeypatch.setattr(_tiles, "ROWS", rows)
    ids = sorted(texts)
    good, head, words = digest.digests([texts[k] for k in ids])
    out = {r.doc_id: r for r in digest.op5_quartile_digest(spark, SF).collect()}
    some = 0
    for i, k in enumerate(ids):
        if not good[i]:
            assert out[k].digest is None and out[k].n_near == 0
            continue
        score = digest.difference(np.repeat(head[i : i + 1], len(ids), 0), np.repeat(words[i : i + 1], len(ids), 0), head, words, 20)
        near = [(int(score[j]), ids[j]) for j in np.flatnonzero((score <= 20) & good) if j != i]
        some += len(near)
        assert (out[k].n_near, out[k].nearest_score, out[k].nearest_id) == (len(near), *(min(near) if near else (None, None)))
    assert some


def test_digest_ties_and_repeated_ids(spark):
    rnd = random.Random(6)
    base = " ".join(_sentences(300, 40))
    other = " ".join(_sentences(300, 41))
    near = base[:-1] + "!"
    rows = [(7, base), (5, base), (9, base), (7, other), (11, near), (None, base)]
    rnd.shuffle(rows)
    out = sorted(((r.doc_id, r.n_near, r.nearest_id, r.nearest_score) for r in digest.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    d = {x: digest.digests([x])[1:] for x in (base, near)}
    score = int(digest.difference(*d[base], *d[near], 20)[0])
    assert 0 < score <= 20
    wanted = [(7, 3, 5, 0), (5, 3, 7, 0), (9, 3, 5, 0), (7, 0, None, None), (11, 3, 5, score), (None, 0, None, None)]
    assert out == sorted(wanted, key=str)


def test_bucket_counts():
    text = "abcdefgabc" * 9
    raw = text.encode()
    one, size = digest.bucket_counts([text])
    two, _ = digest.bucket_counts(["x" * 70, text])
    assert one.sum() == 6 * (len(raw) - 4) and size[0] == len(raw) and (one[0] == two[1]).all()


@pytest.mark.parametrize("planes,block", [("bit", 1 << 16), ("byte", 1000), ("bit", 7)])
def test_planes_round_trip(spark, docs, texts, planes, block):
    some = docs.where("doc_id < 40")
    back = {r.doc_id: r.ids for r in bitplanes.read_planes(bitplanes.bit_planes(some, planes, block)).collect()}
    assert back == {k: _bpe.encode(t).tolist() for k, t in texts.items() if k < 40}


def test_query_planes_round_trip(spark, texts):
    back = {r.doc_id: r.ids for r in bitplanes.read_planes(bitplanes.op6_bit_planes(spark, SF)).collect()}
    assert back == {k: _bpe.encode(t).tolist() for k, t in texts.items()}


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs.where("doc_id % 4 <> 0"))
    held = docs.where("doc_id % 4 = 0")
    truth = {r.doc_id: r.lang for r in held.collect()}
    out = language_id.identify(held, model).collect()
    right = [truth[r.doc_id] == r.language for r in out]
    assert np.mean(right) > 0.93
    sure = np.mean([r.probability for r in out])
    assert abs(sure - np.mean(right)) < 0.1  # calibrated
    assert 0 < np.mean(model.weights != 0) < 1  # sparse


def test_ftrl_and_idf_by_brute_force(spark):
    """The model of plain Python loops over dictionaries: the same frequencies, weights and probabilities."""
    rnd = random.Random(14)
    letters = {"aa": "abcde", "bb": "cdefg"}
    rows = [(k, " ".join("".join(rnd.choice(letters[lang]) for _ in range(4)) for _ in range(6)), lang) for k in range(8) for lang in ("aa", "bb")][:9]
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(rows)]  # fewer than ten: all are trained on
    df = spark.createDataFrame([*rows, (90, None, "aa"), (91, "", "bb"), (92, "unlabelled", None)], "doc_id long, text string, lang string")
    odd, wrap = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), 2**32

    def grams(text):
        out = Counter()
        for n in (1, 2, 3):
            for i in range(len(text) - n + 1):
                h = 0
                for c in text[i : i + n]:
                    h = (h * odd[0] + ord(c) + 1) % wrap
                h = h * (odd[1] + 2 * (n - 1)) % wrap
                h ^= h >> 15
                out[h * odd[2] % wrap >> 17] += 1
        return out

    docs = [t for _, t, _ in rows] + ["unlabelled"]
    df_brute = Counter(g for t in docs for g in grams(t))
    got, total = language_id.document_frequencies(df)
    assert total == len(docs) and {k: int(v) for k, v in enumerate(got) if v} == dict(df_brute)
    idf = {g: math.log((1 + len(docs)) / (1 + n)) + 1 for g, n in df_brute.items()}

    def weighted(text):
        x = {g: (1 + math.log(n)) * idf[g] for g, n in grams(text).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {g: v / norm for g, v in x.items()} | {-1: 1.0}

    model = language_id.train(df)
    ranked = [r.doc_id for r in df.where("length(text) > 0 AND lang IS NOT NULL").selectExpr("doc_id", "text", "pmod(xxhash64(doc_id, 5), 1L << 52) AS rank").orderBy("rank").collect()]
    z, n, order = defaultdict(float), defaultdict(float), np.random.default_rng(5)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 1.0
    weight = lambda k: 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)
    for _ in range(2):
        for k in order.permutation(np.arange(len(ranked))):
            _, text, lang = rows[ranked[k]]
            x = weighted(text)
            logits = [sum(v * weight((g, c)) for g, v in x.items()) for c in ("aa", "bb")]
            p = [math.exp(v - max(logits)) for v in logits]
            p = [v / sum(p) for v in p]
            for j, c in enumerate(("aa", "bb")):
                for g, v in x.items():
                    w, grad = weight((g, c)), v * (p[j] - (c == lang))
                    z[g, c] += grad - (math.sqrt(n[g, c] + grad * grad) - math.sqrt(n[g, c])) / alpha * w
                    n[g, c] += grad * grad
    for (g, c) in list(z):
        assert model.weights[language_id.BUCKETS if g < 0 else g, ("aa", "bb").index(c)] == pytest.approx(weight((g, c)), abs=1e-5)
    assert np.count_nonzero(model.weights) == sum(weight(k) != 0 for k in list(z))


def test_bpe_equals_whole_encoding(spark, docs, texts, monkeypatch):
    wanted = {k: _bpe.encode(t).tolist() for k, t in texts.items()}
    out = chunked_bpe.op8_chunked_bpe(spark, SF)
    assert {r.doc_id: r.ids for r in out.collect()} == wanted
    assert {r.doc_id: r.text for r in chunked_bpe.decode_ids(out).collect()} == texts
    monkeypatch.setattr(chunked_bpe, "BROADCAST_HASHES", -1)
    assert {r.doc_id: r.ids for r in chunked_bpe.op8_chunked_bpe(spark, SF).collect()} == wanted


def test_joins_are_repaired():
    rnd = random.Random(4)
    for _ in range(200):
        text = "".join(rnd.choice(["the ", "re-", "\n", "  ", "é", "don't ", "1234", "𝛼", "of", " "]) for _ in range(60))
        raw, cuts = text.encode(), sorted(rnd.sample(range(60), 4))
        ends = [len(text[:c].encode()) for c in cuts]
        parts = [_bpe.encode(raw[a:b].decode()) for a, b in zip([0, *ends], [*ends, len(raw)])]
        assert chunked_bpe.join_parts(parts).tolist() == _bpe.encode(text).tolist()


def _site():
    rnd = random.Random(9)
    page = lambda k: (
        f"<html><head><title>t{k}</title></head><body><div class=menu><a>Home</a><a>News</a><a>About</a></div>"
        f"<div class=content><h1>Title {k} {rnd.random()}</h1>" + "".join(f"<p>Paragraph {rnd.random()} of page {k}.</p>" for _ in range(1 + k % 3)) + "</div><div class=foot>All rights reserved.</div></body></html>"
    )
    return [(k, f"http://site.example/{k}", page(k)) for k in range(30)] + [(100 + k, f"http://small{k}.example/", page(k)) for k in range(3)]


def test_style_tree(spark):
    rows = _site()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r for r in style_tree.extract(df).collect()}
    for k, _, page in rows:
        whole = visible_text(parse(page))[0].split("\n")
        if k < 100:
            assert out[k].text.split("\n") == [x for x in whole if x.startswith(("Title", "Para"))]
        else:
            assert out[k].text.split("\n") == whole and out[k].n_removed == 0


def test_copies_of_a_page_are_not_furniture(spark, monkeypatch):
    rows = [(k, "http://copies.example/", "<div><p>An article of its own.</p><p>With two paragraphs.</p></div>") for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (style_tree.BROADCAST_COPIES, -1):
        monkeypatch.setattr(style_tree, "BROADCAST_COPIES", most)
        assert {(r.text, r.n_removed) for r in style_tree.extract(df).collect()} == {("An article of its own.\nWith two paragraphs.", 0)}
    mixed = spark.createDataFrame(_site() + [(1000 + k, "http://site.example/c", _site()[4][2]) for k in range(20)], "page_id long, url string, html string")
    one = {r.page_id: r.text for r in style_tree.extract(mixed).collect()}
    assert one[4] == one[1000] == {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(_site(), "page_id long, url string, html string")).collect()}[4]
    monkeypatch.setattr(style_tree, "BROADCAST_NODES", -1)
    assert {r.page_id: r.text for r in style_tree.extract(mixed).collect()} == one


def test_style_tree_importance_by_hand(spark):
    rows = _site()[:30]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("'h' AS host", "html")
    got = {r.node: r.importance for r in style_tree.importance(df).collect()}
    sums, styles, kids, under, features = defaultdict(int), defaultdict(Counter), {}, defaultdict(list), defaultdict(lambda: defaultdict(Counter))
    for k, _, page in rows:
        for node, _, above in identify(parse(page)):
            if node.tag in style_tree.HIDDEN:
                continue
            sums[node.key] += 1
            styles[node.key][node.style] += 1
            kids[node.style] = len(node.children)
            if node.key not in under[above]:
                under[above].append(node.key)
            if node.text is not None:
                for s in re.split(r"(?<=[.!?])\s+", node.text):
                    features[node.key][s][k] += 1

    def value(key):
        m = sums[key]
        if m < 8:
            return 1.0
        inner = [s for s in styles[key] if kids[s]]
        if not inner:
            ent = [-sum(c / sum(f.values()) * math.log(c / sum(f.values())) for c in f.values()) / math.log(m) for f in features[key].values()]
            return 1 - min(1, sum(ent) / len(ent)) if ent else 1.0
        own = -sum(c / m * math.log(c / m) for c in styles[key].values()) / math.log(m)
        fade = 0.9 ** len(styles[key])
        share = sum(styles[key][s] for s in inner)
        return (1 - fade) * own + fade * sum(styles[key][s] / share * sum(map(value, under[s])) / kids[s] for s in inner)

    assert set(got) == set(sums)
    for key in sums:
        assert got[key] == pytest.approx(value(key), abs=1e-9)


def test_query_style_tree(spark):
    out = {r.page_id: r for r in style_tree.op9_site_style_tree(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(out) == len(pages)
    for p in pages:
        whole = visible_text(parse(p.html))[0]
        assert Counter(out[p.page_id].text.split()) <= Counter(whole.split())


def test_balancing_is_raking(spark, docs):
    """Entropy balancing has the solution of iterative proportional fitting."""
    rows = docs.collect()
    targets = {"src0": 3.0, "src1": 1.0, "src2": 1.0}
    tokens = lambda r: -(-len((r.text or "").encode()) // 4)
    cell = Counter()
    for r in rows:
        if r.source in targets:
            cell[r.source, r.lang] += tokens(r)
    total, want_lang = sum(cell.values()), Counter()
    for (s, lang), v in cell.items():
        want_lang[lang] += v
    w = dict.fromkeys(cell, 1.0)
    for _ in range(3000):
        for axis, want in ((0, {s: t / 5 * total for s, t in targets.items()}), (1, want_lang)):
            have = Counter()
            for c in cell:
                have[c[axis]] += w[c] * cell[c]
            for c in cell:
                w[c] *= want[c[axis]] / have[c[axis]]
    out = balancing.balanced_copies(docs, targets).collect()
    kind = {r.doc_id: (r.source, r.lang) for r in rows}
    for r in out:
        rate = w.get(kind[r.doc_id], 0.0) if r.tokens else 0.0
        assert r.rate == pytest.approx(rate, rel=1e-4, abs=1e-6) and r.copies in (math.floor(rate - 1e-6), math.floor(rate + 1e-6), math.floor(rate + 1e-6) + 1)


def test_query_balancing_meets_its_targets(spark, docs):
    out = balancing.op10_entropy_balancing(spark, SF).collect()
    sums = Counter()
    for r in out:
        sums[r.source] += r.rate * r.tokens
    assert max(sums.values()) == pytest.approx(min(sums.values()), rel=1e-4)


def test_dates_stay_in_their_range():
    worker, back = pseudonyms.Pseudonymiser(b"k"), pseudonyms.Pseudonymiser(b"k", back=True)
    days = [dt.date(1900, 1, 1) + dt.timedelta(k) for k in range(0, 73049, 271)]
    images = [worker.replace(d.isoformat())[0] for d in days]
    assert len(set(images)) == len(days) and all("1900" <= i[:4] <= "2099" for i in images)
    assert [back.replace(i)[0] for i in images] == [d.isoformat() for d in days]


@pytest.mark.parametrize(
    "line,values",
    [
        ("4111 1111 1111 1111 123", ["4111 1111 1111 1111"]),
        ("4111 1111 1111 1111 12/27", ["4111 1111 1111 1111"]),
        ("12 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
        ("12-4111-1111-1111-1111", ["4111-1111-1111-1111"]),
        ("1234567 4111 1111 1111 1111 99", ["4111 1111 1111 1111"]),
        ("DE89 3704 0044 0532 0130 00 BIC COBADEFF", ["DE89 3704 0044 0532 0130 00"]),
        ("DE89370400440532013000 12345", ["DE89370400440532013000"]),
        ("AB12 DE89 3704 0044 0532 0130 00 AND 4111 1111 1111 1111", ["DE89 3704 0044 0532 0130 00", "4111 1111 1111 1111"]),
        ("XX11 REF NUMBER 4111 1111 1111 1111 123", ["4111 1111 1111 1111"]),
        ("AB12 CDEF GHIJ 123-45-6789", ["123-45-6789"]),
    ],
)
def test_values_beside_digits_and_capitals(line, values):
    for k in range(30):
        worker, back = pseudonyms.Pseudonymiser(b"k%d" % k), pseudonyms.Pseudonymiser(b"k%d" % k, back=True)
        new, n = worker.replace(line)
        assert n == len(values) and all(v not in new for v in values)
        assert back.replace(new) == (line, n)
        at = 0
        for v in values:  # only the values change
            a = line.index(v, at)
            assert new[at:a] == line[at:a]
            at = a + len(v)
        assert new[at:] == line[at:]


def _best_scores(p, q):
    """Quadratic chaining of matches that don't touch: the best score of a chain that ends in each."""
    order, best, size = sorted(range(len(p)), key=lambda i: (p[i], q[i])), {}, chaining.K
    for i in order:
        gaps = {j: (p[i] - p[j] - size, q[i] - q[j] - size) for j in best}
        best[i] = size + max([best[j] - chaining.GAP_COST * (x + y) for j, (x, y) in gaps.items() if 0 <= x <= chaining.MOST_GAP and 0 <= y <= chaining.MOST_GAP] + [0])
    return best


def test_chains_are_those_of_quadratic_chaining():
    rnd = np.random.default_rng(5)
    for _ in range(1000):
        p = np.sort(rnd.choice(400, 30, replace=False)) * 3
        q = p + rnd.integers(-6, 6, 30) * 12
        # the first and best chain, and no match is nearer on its diagonal than those that are joined
        keep = [i for i in range(30) if not any(p[i] - q[i] == p[j] - q[j] and abs(p[i] - p[j]) <= chaining.K + 4 for j in range(30) if j != i)]
        p, q = p[keep], q[keep]
        c = chaining.chains(p, q)[0]
        gaps = (c[1:, :2] - c[:-1, :2] - c[:-1, 2:]).sum()
        assert c[:, 2].sum() - chaining.GAP_COST * gaps == pytest.approx(max(_best_scores(p, q).values()))


def test_a_long_run_does_not_hide_near_matches():
    later = 1000 + 60 + np.arange(12) * 14
    p = np.concatenate((np.arange(0, 1000, 5), later))
    q = np.concatenate((np.arange(0, 1000, 5), later + 50))
    found = chaining.chains(p, q)
    assert [len(c) for c in found] == [1, 12]


def test_passages_whose_parts_first_stood_elsewhere(spark):
    shared = _sentences(60, 11)
    pieces = {1: shared[:30], 2: shared[30:], 3: shared[10:40], 4: shared, 5: shared[:35], 6: shared[25:], 7: shared[15:50], 8: shared}
    rows = [(k, " ".join(_sentences(30, 20 + k) + v + _sentences(30, 40 + k))) for k, v in pieces.items()]
    out = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.ref_doc_id): r.n_words for r in out}
    assert got[8, 4] >= 60
    halves = [(1, shared[:30]), (2, shared[30:]), (3, shared), (4, shared)]
    rows = [(k, " ".join(_sentences(30, 60 + k) + v + _sentences(30, 80 + k))) for k, v in halves]
    out = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.ref_doc_id): r.n_words for r in out} == {(4, 3): 60}


def test_a_passage_whose_quarters_stand_elsewhere(spark):
    shared = _sentences(240, 31)
    docs = {k: _sentences(40, 50 + k) + shared[60 * (k - 1) : 60 * k] + _sentences(40, 60 + k) for k in range(1, 5)}
    docs |= {k: _sentences(30, 70 + k) + shared + _sentences(30, 80 + k) for k in (10, 11)}
    out = chaining.repeated_passages(spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string"), min_words=100).collect()
    assert [(r.doc_id, r.ref_doc_id, r.n_words) for r in out] == [(11, 10, 240)]


def test_a_passage_whose_parts_stand_in_many_documents(spark):
    """More documents than MANY hold each part, so only the words that follow a seed lead to the one that holds the whole."""
    shared = _sentences(70, 32)
    docs = {100 * j + k: _sentences(20, 1000 + 100 * j + k) + shared[14 * j : 14 * j + 14] + _sentences(20, 2000 + 100 * j + k) for j in range(5) for k in range(20)}
    docs |= {k: _sentences(20, 3000 + k) + shared + _sentences(20, 4000 + k) for k in (900, 901)}
    out = chaining.repeated_passages(spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.ref_doc_id) for r in out] == [(901, 900)] and out[0].n_words >= 70


@pytest.mark.parametrize("hot", [False, True])
def test_a_fuzzy_passage_whose_seeds_are_all_in_many_documents(spark, monkeypatch, hot):
    """Every seed is in more than MANY documents, in none of whose first two the passage stands, and no 40 words are the same: only stretches lead to the other document."""
    if hot:
        monkeypatch.setattr(chaining, "SAMPLE", 1)
        monkeypatch.setattr(chaining, "LEAST_HOT", 5)
        monkeypatch.setattr(chaining, "HOT_SHARE", 0.0)
    parts = [_sentences(16, 60 + j) for j in range(5)]
    docs = {100 * j + k: _sentences(20, 5000 + 100 * j + k) + parts[j] + _sentences(20, 6000 + 100 * j + k) for j in range(5) for k in range(20)}
    for k in (900, 901, 902):  # three words between the parts differ
        docs[k] = _sentences(20, 7000 + k) + sum([p + _sentences(3, 100 * k + j) for j, p in enumerate(parts)], []) + _sentences(20, 8000 + k)
    rows = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    out = {r.doc_id: r for r in chaining.repeated_passages(rows).collect()}
    assert set(out) == {901, 902} and all(r.ref_doc_id in (900, 901) and r.n_words >= 85 and r.n_matched >= 80 for r in out.values())


@pytest.mark.parametrize("hot", [False, True])
def test_pairs_of_seeds_by_brute_force(spark, docs, texts, monkeypatch, hot):
    """Seeds of few documents meet all lesser ones, others the first and those in which the following words are the same; hot ones too, by another way."""
    monkeypatch.setattr(chaining, "MANY", 3)
    if hot:
        monkeypatch.setattr(chaining, "SAMPLE", 1)
        monkeypatch.setattr(chaining, "LEAST_HOT", 5)
        monkeypatch.setattr(chaining, "HOT_SHARE", 0.0)
    work = docs.selectExpr("doc_id AS id", "text").where("length(text) > 0")
    held = defaultdict(lambda: defaultdict(list))
    words = {}
    for k, t in texts.items():
        if t:
            w = chaining.split_words([t])
            words[k] = w.hashes.tolist()
            for p, h in zip(*chaining.seeds(w)[1:]):
                held[int(h)][k].append(int(p))
    got = defaultdict(set)
    for r in chaining.matched_seeds(work, 40).collect():
        assert r.ref < r.id
        p, q = (r.pos, r.ref_pos) if r.pos >= 0 else (-1 - r.pos, -1 - r.ref_pos)
        n = 40 if r.pos < 0 else chaining.K
        assert words[r.id][p : p + n] == words[r.ref][q : q + n]
        got[r.id, p].add(r.ref)
    for h, places in held.items():
        ids = sorted(places)
        for k in ids[1:]:
            lesser = [j for j in ids if j < k]
            wanted = set(lesser if len(ids) <= 3 and not (hot and sum(map(len, places.values())) >= 5) else lesser[:2])
            for p in places[k]:
                assert wanted <= got[k, p]
                run = words[k][p : p + 40]
                same = {j for j in lesser for q in places[j] if len(run) == 40 and words[j][q : q + 40] == run}
                assert not same or same & got[k, p]


def test_gaps_are_aligned_with_least_edits_and_most_matches():
    assert chaining._gap(np.array([1, 2, 3]), np.array([2, 3, 4])) == (2, 4)
    rnd = random.Random(17)
    for _ in range(300):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(1, 7))] for _ in range(2))
        best = {(0, 0): (0, 0)}  # (edits, -matches)
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                tries = []
                if i and j:
                    e, m = best[i - 1, j - 1]
                    tries.append((e + (a[i - 1] != b[j - 1]), m - (a[i - 1] == b[j - 1])))
                for x, y in ((i - 1, j), (i, j - 1)):
                    if x >= 0 and y >= 0:
                        tries.append((best[x, y][0] + 1, best[x, y][1]))
                if tries:
                    best[i, j] = min(tries)
        edits, matches = best[len(a), len(b)]
        assert chaining._gap(np.array(a), np.array(b)) == (-matches, edits - matches)


def test_passages_say_what_they_match(spark, docs, texts):
    """Every row's places hold the words that it counts, by an alignment of the two passages alone."""
    from difflib import SequenceMatcher

    out = chaining.op2_collinear_chains(spark, SF).collect()
    assert out
    for r in out:
        a = re.findall(rb"[a-z0-9\x80-\xff]+", texts[r.doc_id][r.start_char : r.end_char].encode().lower())
        b = re.findall(rb"[a-z0-9\x80-\xff]+", texts[r.ref_doc_id][r.ref_start_char : r.ref_end_char].encode().lower())
        assert r.ref_doc_id < r.doc_id and len(a) == r.n_words >= 40 and len(b) >= 40 and 0.7 <= r.identity <= 1
        assert r.n_matched <= min(len(a), len(b)) and (a == b) == (r.identity == 1.0)
        longest = _common(a, b)
        assert r.n_matched <= longest and r.n_matched >= 0.9 * longest, SequenceMatcher(None, a, b).ratio()


def test_chains_of_groups_are_those_of_each():
    rnd = np.random.default_rng(8)
    group, p, q = np.sort(rnd.integers(0, 9, 400)), rnd.integers(0, 300, 400), rnd.integers(0, 300, 400)
    owner, first, rows = chaining.chain_groups(group, p, q)
    for g in range(9):
        mine = [rows[x:y, :3].tolist() for o, x, y in zip(owner, first[:-1], first[1:]) if o == g]
        assert mine == [c.tolist() for c in chaining.chains(p[group == g], q[group == g])]


def test_few_chains_are_aligned_and_no_passage_is_lost(spark, monkeypatch):
    """Of all chains the best of each document are aligned, and those that may stand out of them: what aligning all of them finds lies within, or stands out by less than EDGE words."""
    stored, store = {}, chaining.materialise

    def kept(df, tag):
        return stored.setdefault(tag, store(df, tag))

    def all_first(min_words):
        return lambda frames: (f.drop(columns="words").assign(first=True) for f in frames)

    shared, stock = _sentences(80, 91), _sentences(18, 92)
    texts = {k: " ".join(_sentences(20, 300 + k) + [w if j != 5 * k + 10 else f"x{k}" for j, w in enumerate(shared)] + _sentences(20, 400 + k)) for k in range(12)}
    texts |= {20 + k: " ".join(_sentences(40, 500 + k) + stock + (shared[30:75] if k == 7 else _sentences(40, 600 + k))) for k in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(chaining, "materialise", kept)
    found = defaultdict(list)
    for r in chaining.repeated_passages(docs).collect():
        found[r.doc_id].append(r)
    chains = stored["chains"]
    assert 2 * (chains.where("first").count() + stored["other-chains"].count()) < chains.count()
    monkeypatch.setattr(chaining, "materialise", store)
    monkeypatch.setattr(chaining, "_first_frames", all_first)
    words = lambda t: len(re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", t))
    assert set(found) == {*range(1, 12), 27}
    for r in chaining.repeated_passages(docs).collect():
        t = texts[r.doc_id]
        assert any(words(t[r.start_char : f.start_char]) < chaining.EDGE and words(t[f.end_char : r.end_char]) < chaining.EDGE for f in found[r.doc_id])


def _common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = last + 1 if x == y else max(row[j + 1], row[j])
            last = keep
    return row[-1]


def test_recall_by_identity(spark):
    """Passages of 80 words with words changed at random: how many are found, by identity; the README states these figures."""
    rnd, rows, wanted = random.Random(21), [], {}
    for n, identity in enumerate((0.95, 0.9, 0.85, 0.8)):
        for k in range(60):
            shared = _sentences(80, 5000 + 100 * n + k)
            changed = [w if rnd.random() < identity else f"x{rnd.randrange(10**6)}" for w in shared]
            one = 10_000 * (n + 1) + 2 * k
            rows += [(one, " ".join(_sentences(30, 9000 + one) + shared)), (one + 1, " ".join(changed + _sentences(30, 19000 + one)))]
            wanted[one + 1] = (identity, one)
    out = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = Counter(wanted[r.doc_id][0] for r in {(r.doc_id, r.ref_doc_id): r for r in out}.values() if wanted[r.doc_id][1] == r.ref_doc_id)
    print({k: v / 60 for k, v in found.items()})
    assert found[0.95] >= 57 and found[0.9] >= 48


def test_rare_templates_of_a_large_host_go(spark):
    rnd = random.Random(12)
    rows = []
    for k in range(1200):  # a footer on 20 pages, less than 2 % of the host, and one beside a varying number of paragraphs
        paras = "".join(f"<p>Paragraph {rnd.random()} of page {k}.</p>" for _ in range(1 + k % 60))
        foot = "<div class=rare><a>Imprint</a><a>Contact</a></div>" if k % 60 == 7 else ""
        rows.append((k, f"http://big.example/{k}", f"<html><body>{paras}{foot}<div class=foot>All rights reserved.</div></body></html>"))
    out = style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    lines = Counter(x for r in out for x in r.text.split("\n"))
    assert lines["All rights reserved."] == 0 and lines["Imprint"] == 0 and lines["Contact"] == 0
    assert sum(n for x, n in lines.items() if x.startswith("Para")) == sum(1 + k % 60 for k in range(1200))


def test_balancing_says_what_it_cannot_meet(spark):
    """One source has one language only, so equal sources and the languages' shares contradict each other."""
    rows = [(k, "word " * 40, "s1" if k % 4 else "s2", "en" if k % 4 else "de") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    with pytest.warns(UserWarning, match="can't all be met"):
        out = balancing.balanced_copies(df).collect()
    assert all(r.met is False and np.isfinite(r.rate) for r in out)
    good = balancing.balanced_copies(df, balance=()).collect()
    assert all(r.met for r in good)
    with pytest.raises(ValueError, match="s9"):
        balancing.balanced_copies(df, {"s1": 1.0, "s9": 1.0})
    same = balancing.balanced_copies(df.unionByName(df), balance=()).collect()  # ties and repeated rows
    assert sorted(r.rate for r in same) == pytest.approx(sorted(r.rate for r in good for _ in range(2)), rel=1e-6)


def test_query_balancing_counts_the_encoded_ids(spark, texts):
    out = balancing.op10_entropy_balancing(spark, SF).collect()
    shares = Counter()
    for r in out:
        n = len(_bpe.encode(texts[r.doc_id])) if texts[r.doc_id] is not None else 0
        assert r.tokens == n
        shares[r.source] += r.rate * n
    assert max(shares.values()) == pytest.approx(min(shares.values()), rel=1e-4)
