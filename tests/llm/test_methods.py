"""Each method against brute force, its library, or what it learned."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import components, decontaminate, language, lm, pieces, quality, secrets, simhash
from quern.llm.common import held_out, word_hashes, word_spans

from .conftest import prose, rows


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def fingerprint(text):
    w = words_of(text)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def components_of(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_by_brute_force(spark, docs, write_tables):
    data = rows()
    fps = [fingerprint(r[1]) for r in data]
    group = components_of(fps, 2)
    least = {}
    for r, g in zip(data, group, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = sorted(str((r[0], f"{f:016x}", least.get(g))) for r, f, g in zip(data, fps, group, strict=True))
    folder = write_tables(documents=docs)
    assert sorted(str(tuple(r)) for r in simhash.op2_simhash(spark, folder).select("doc_id", "fingerprint", "component_id").collect()) == want


@pytest.mark.parametrize(("radius", "tile"), [(1, 4096), (2, 3), (2, 4096), (9, 37), (9, 4096)])
def test_links_by_brute_force(spark, monkeypatch, radius, tile):
    """Fingerprints that cluster, in small tiles too."""
    rng = random.Random(5)
    monkeypatch.setattr(simhash, "TILE", tile)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {0}
    for b in base:
        for _ in range(15):
            fps.add(b := b ^ (1 << rng.randrange(64)) ^ ((1 << rng.randrange(64)) if rng.random() < 0.4 else 0))
    fps = sorted(fps)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(s, [s]) for s in signed], "id long, sketch array<long>")
    got = {r["node"]: r["root"] for r in components.connected_components(simhash.near_links(nodes, radius)).collect()}
    group = components_of(fps, radius)
    want: dict[int, int] = {}
    for s, g in zip(signed, group, strict=True):
        want[g] = min(want.get(g, s), s)
    assert all(got.get(s, s) == want[g] for s, g in zip(signed, group, strict=True))


@pytest.mark.parametrize("items", [0, 1 << 18])
def test_tiles_of_far_population_counts_never_meet(spark, monkeypatch, items):
    """All pairs within the radius are in one tile pair at least; tiles are of bounded size, and of no others than near counts."""
    monkeypatch.setattr(simhash, "TILE", 4 if not items else 4096)
    monkeypatch.setattr(simhash, "SET_ITEMS", 1 << 20)
    rng = random.Random(35)
    rows_ = [(i, [(1 << min(rng.randrange(0, 40), rng.randrange(0, 60))) - 1], i % 3, items) for i in range(240)] + [(1000, [3], 7, items), (1001, [1], 7, items)]
    pairs = simhash._tile_pairs(spark.createDataFrame(rows_, "id long, sketch array<long>, bucket long, items long"), 2).collect()
    pop, met = {i: sketch[0].bit_count() for i, sketch, *_ in rows_}, set()
    by_pair = {}
    for r in pairs:
        by_pair.setdefault((r["bucket"], r["i"], r["j"]), ([], []))[r["side"]].append(r["id"])
    tiles = {(b, i): ids for (b, i, j), (ids, _) in by_pair.items() if i == j}
    assert sorted(x for ids in tiles.values() for x in ids) == sorted(pop) and max(map(len, tiles.values())) <= 12

    def planned(b, tile):
        """The counts that may be dealt to a tile, whether or not a row of each is."""
        own, before, out = Counter(pop[i] for i, _, bucket, _ in rows_ if bucket == b), 0.0, []
        for p, n in sorted(own.items()):
            fill = n / 4 if not items else n * items / (1 << 20)
            lo = math.floor(before)
            if lo <= tile <= max(lo, math.ceil(before + fill) - 1):
                out.append(p)
            before += fill
        return out

    for (b, i, j), (left, right) in by_pair.items():
        assert not right if i == j else (set(left) <= set(tiles[b, i]) and set(right) <= set(tiles[b, j]))
        right = left if i == j else right
        span = planned(b, i), planned(b, j)
        assert min(span[1]) - max(span[0]) <= 2 and min(span[0]) - max(span[1]) <= 2
        met |= {frozenset((x, y)) for x in left for y in right}
    assert all(frozenset((x, y)) in met for x, _, a, _ in rows_ for y, _, b, _ in rows_ if a == b and abs(pop[x] - pop[y]) <= 2)
    assert len(by_pair) < len(tiles) * (len(tiles) + 1) / 6


def test_of_buckets_with_the_same_ids_one_is_compared(spark):
    keyed = spark.createDataFrame([(1, 10), (2, 10), (1, 11), (2, 11), (1, 12), (3, 13), (1, 14), (2, 14), (3, 14)], "id long, bucket long")
    assert sorted(map(tuple, simhash._shared_buckets(keyed).select("bucket", "id").collect())) == [(10, 1), (10, 2), (14, 1), (14, 2), (14, 3)]


def test_frequent_keys_are_dealt_to_several_tasks(spark, monkeypatch):
    import quern.llm.common as common

    monkeypatch.setattr(common, "HOT", 10)
    left = spark.createDataFrame([(i % 3 if i < 60 else 99, i) for i in range(400)], "k long, x long")
    right = common.written(left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least")), "right")
    both = common.split_join(left, right, ["k"], "n", "x")
    assert "_piece" in both._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, both.collect())) == sorted((k, x, 60 if k == 99 else k) for k, x in map(tuple, left.collect()))


def test_shingles_of_long_texts_in_pieces(monkeypatch):
    text = prose(random.Random(2), 5000).encode()
    whole = simhash.shingle_hashes(text, 3)
    monkeypatch.setattr(simhash, "_PIECE", 97)
    assert np.array_equal(whole, simhash.shingle_hashes(text, 3)) and len(whole) == 4998


def test_secrets_by_brute_force(spark, write_tables):
    rng = random.Random(9)
    parts = ["password=hunter22", "api_key: 'abcDEF123'", "Secret=token=abcdef123", "secret: token: abcdefgh", "AKIA" + "Q7" * 9, "AKIAXAKIA12", "0123456789abcdef0123456789", "deadbeef", "ghp_" + "a1" * 20, "ghp_xxghp_" + "b2" * 20, "-----BEGIN RSA PRIVATE KEY-----", "pass word", "tokEn='é", "APIKEY=....//==", "😀é", "cafe"]
    texts = [" ".join(rng.choice(parts) + rng.choice(["", "\n", "x"]) for _ in range(rng.randrange(1, 30))) for _ in range(120)] + [None, "", "ab" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.find_secrets(df).collect():
        text, want = texts[r["doc_id"]] or "", []
        for k, rule in enumerate(secrets.RULES):
            want += [(m.start(), k, m.end(), rule.kind) for m in re.finditer(rule.regex, text) if len(m[rule.group]) >= rule.least]
        assert [tuple(x) for x in r["found"]] == sorted(want)


def test_secrets_of_a_text_with_very_many(spark):
    """Places are running sums: a hundred thousand matches in one text."""
    text = " ".join(f"token=abcdef{i}" for i in range(100_000))
    found = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("found"), F.col("found")[77_777]).first()
    want = next(m for i, m in enumerate(re.finditer(secrets.BASE[0].regex, text)) if i == 77_777)
    assert found[0] == 100_000 and (found[1]["start"], found[1]["end"]) == want.span()


@pytest.mark.parametrize("n", [1, 3, 4, 5, 17])
def test_running_sums(spark, n):
    xs = [3 * i + 1 for i in range(n)]
    got = spark.createDataFrame([(xs,)], "xs array<int>").select(secrets.running(F.col("xs"), 4)).first()[0]
    assert got == [sum(xs[:i]) for i in range(n + 1)]


def test_postings_are_intersected(spark, monkeypatch, docs):
    """The stored lists name the documents that have a trigram; the candidates are those whose trigrams satisfy a rule's query."""
    monkeypatch.setattr(secrets, "BLOCK", 3)
    texts = ["my PassWord", "pass", "word", "ghp_", "api key", "apikey", "api_key", "akia", "AKIA77", "secre token"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = secrets.TrigramIndex()
    postings = index.postings(df)
    lists = {}
    for r in postings.collect():
        assert 1 <= len(r["docs"]) <= 3
        lists.setdefault(index.vocabulary[r["trigram"]], set()).update(d["doc_id"] for d in r["docs"])
    assert all(lists.get(t, set()) == {i for i, x in enumerate(texts) if t in x.lower()} for t in index.vocabulary)
    got = {r["doc_id"]: {k for k in index.queries if index.queries[k] and r[f"has_{k}"]} for r in index.candidates(postings).collect()}
    for i, x in enumerate(texts):
        want = {k for k, q in index.queries.items() if q and all(any(all(t in x.lower() for t in option) for option in clause) for clause in q)}
        assert got.get(i, set()) == want


def test_trigrams_are_mandatory():
    """No match of a rule lacks the trigrams that its query names."""
    samples = {"assign": ["PassWord = abcdef", "api_key:'123456'", "apikey=......"], "access": ["AKIA" + "A" * 16], "github": ["gho_" + "x" * 36], "pem": ["-----BEGIN PRIVATE KEY-----"], "google": ["AIza" + "b" * 35]}
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.regex)
        for s in samples.get(rule.kind, ()):
            low = s.lower()
            assert query and all(any(all(t in low for t in option) for option in clause) for clause in query)
    assert secrets.trigram_query("[0-9a-f]+") == []


def test_decontamination_finds_passages_and_spares_the_rest(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randrange(12, 60))) for i in range(20)]
    texts, want = [], {}
    for i in range(120):
        t, k = prose(rng, rng.randrange(0, 200)), i % 4
        item = rng.choice(items)
        own = item[1].split()
        if k == 0:
            passage = own
        elif k == 1 and len(own) >= 20:
            passage = own[3:]
        elif k == 2 and len(own) >= 16:  # one word in nine is another
            passage = [w if j % 9 != 4 else "zzz" for j, w in enumerate(own)]
        else:
            passage = []
        at = rng.randrange(len(t.split()) + 1)
        ws = t.split()
        texts.append((i, " ".join(ws[:at] + passage + ws[at:])))
        if passage:
            want[i] = item[0]
    found = {r["doc_id"]: set(r["item_ids"]) for r in decontaminate.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(found) == 120 and all(want[i] in found[i] for i in want)
    toks = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]

    def overlap(doc, item):
        """The best window of the item over every shift."""
        d, q = toks(doc), toks(item)
        width = min(len(q), decontaminate.WINDOW)
        best = 0.0
        for shift in range(-len(q), len(d) + 1):
            same = [0 <= i + shift < len(d) and d[i + shift] == t for i, t in enumerate(q)]
            best = max(best, max(sum(same[i : i + width]) for i in range(len(q) - width + 1)) / width)
        return best

    by_id, item_of = dict(texts), dict(items)
    for i, got in found.items():
        for j in got:
            assert overlap(by_id[i], item_of[j]) >= decontaminate.SHARE
    clean = [i for i in found if i not in want]
    assert sum(bool(found[i]) for i in clean) == sum(any(overlap(by_id[i], t) >= decontaminate.SHARE for t in item_of.values()) for i in clean)


def test_decontamination_finds_every_allowed_substitution_at_every_place(spark):
    """Items of 1 to 14 tokens, all sets of allowed substitutions, at even and odd places, at the ends of a text too."""
    from itertools import combinations

    items, texts, want = [], [], {}
    for n in range(1, 15):
        own = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(own)))
        k = min(n, 13) - math.ceil(0.8 * min(n, 13) - 1e-9)
        for gone in combinations(range(n), k):
            for before in (0, 4, 5):
                want[len(texts)] = n
                texts.append((len(texts), " ".join([f"a{i}" for i in range(before)] + ["zzz" if i in gone else w for i, w in enumerate(own)] + ["end"] * (before % 2))))
        if k:  # the item without its first and its last tokens is the whole text
            for part in (own[k:], own[: n - k]):
                want[len(texts)] = n
                texts.append((len(texts), " ".join(part)))
    found = decontaminate.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [texts[r["doc_id"]] for r in found if r["item_ids"] != [want[r["doc_id"]]]] == []


def test_pieces_are_those_of_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    t = pieces.transducer(open(pieces.MODEL, "rb").read())  # noqa: SIM115
    rng = random.Random(6)
    samples = ["", " ", "a", "  two  blanks ", "Ünïcödé 漢字 😀", "tab\tand\nline", "x" * 300, "<s> <unk> </s>", "▁ ▁▁x", "1234567890", "\x00\x7f", "don't—stop…"]
    samples += [prose(rng, rng.randrange(1, 80), lang) for lang in ("en", "fr", "de") for _ in range(40)]
    samples += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x4E00, 0x4F00)])) for _ in range(60)) for _ in range(40)]
    for s in samples:
        assert t.encode(s).tolist() == sp.encode(s), s
        assert t.decode(t.encode(s)) == sp.decode(sp.encode(s)), s


def test_unigram_paths_are_the_shortest():
    """A made-up unigram model beside all ways to cut a short text."""
    m = pieces.PieceModel(["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "aba"], [0, -3, -2, -2.5, -3.2, -3.1, -4, -4.5], [2, 1, 1, 1, 1, 1, 1, 1])
    t = pieces.PieceTransducer(m)
    weight = lambda p: float(-t.score[p] if p in t.score else -t.unknown_score)

    def best(s):
        if not s:
            return 0.0
        return min([best(s[n:]) + weight(s[:n]) for n in range(1, min(3, len(s)) + 1) if s[:n] in t.score] + ([best(s[1:]) + weight(s[0])] if s[0] not in t.score else []))

    for s in ("ab", "abab", "aabba", "bbab", "axb"):
        part = t.normalise(s)
        path = t.shortest_path(part)
        assert "".join(path) == part and math.isclose(sum(map(weight, path)), best(part), rel_tol=1e-6)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    """A field of a protocol-buffer message."""
    import struct

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


@pytest.mark.parametrize(("fallback", "mapped"), [(False, False), (True, False), (False, True), (True, True)])
def test_unigram_encoding_is_that_of_the_library(fallback, mapped):
    """A unigram model put together by hand, with the library's own character map, and with byte fallback."""
    import sentencepiece

    rng = random.Random(17)
    known = sorted({"▁", *"abcdeé1", *("".join(rng.choice("abcdeé▁1"[: 7 if i else 8]) for i in range(rng.randrange(2, 6))) for _ in range(150))})
    own = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256 if fallback else 0)), *((p, -rng.uniform(2, 12), 1) for p in known)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, float(score)) + field(3, kind)) for p, score, kind in own)
    rules = dict(pieces._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc" if mapped else "identity").serialized_model_proto()))[3]
    data += field(2, field(3, 1) + field(35, int(fallback))) + field(3, field(1, b"own") + field(2, dict(pieces._fields(rules)).get(2, b"")) + field(3, 1) + field(4, 1) + field(5, 1))
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    t = pieces.transducer(data)
    letters = "aaabbbcccdddeeeé1 \t\nxyＡ①½ﬁ\u200b漢😀e\u0301A"
    for _ in range(400):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 40)))
        assert t.encode(s).tolist() == sp.encode(s), s
        assert t.decode(t.encode(s)) == sp.decode(sp.encode(s)), s


def test_paths_in_bounded_memory(monkeypatch):
    data = open(pieces.MODEL, "rb").read()  # noqa: SIM115
    monkeypatch.setattr(pieces, "_KEPT_BYTES", 20_000)
    monkeypatch.setattr(pieces, "_KEPT_PAIRS", 50)
    small, large = pieces.PieceTransducer(pieces.PieceModel.parse(data)), pieces.transducer(data)
    rng = random.Random(18)
    for _ in range(20):
        s = prose(rng, 200)
        assert small.encode(s).tolist() == large.encode(s).tolist()
        assert len(small.paths) + len(small.elder) <= 110 and sum(map(len, small.pairs.values())) <= 50


def test_base_scores_by_brute_force(docs):
    from zlib import crc32

    data = [(r[0], words_of(r[1]) + [None]) for r in rows()]
    learn = [crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in data]
    c = Counter(w for (_, ws), yes in zip(data, learn, strict=True) if yes for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(str((i, not yes, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4))) for (i, ws), yes in zip(data, learn, strict=True))
    got = lm.score_texts(docs, ~held_out(7, 2)).collect()
    assert sorted(str((r["doc_id"], not r["learn"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4))) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_model_beats_unigrams_on_text_it_has_not_seen(spark):
    rng = random.Random(8)
    chain = {w: rng.sample("red green blue gold gray pink cyan lime".split(), 2) for w in "red green blue gold gray pink cyan lime".split()}

    def text():
        w = rng.choice(list(chain))
        out = [w]
        for _ in range(60):
            out.append(w := rng.choice(chain[w]))
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string").repartition(4)
    got = lm.score_texts(df, ~held_out(7, 2)).where("NOT learn").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.75 * got[1]  # log-probabilities: nearer to zero is better


def weights_of(model, texts):
    import pyarrow as pa

    got = [r for b in lm._trainer(model)([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]) for r in b.to_pylist()]
    return {r["seen"] for r in got}, b"".join(r["w"] for r in got)


def test_training_takes_every_token_of_every_text():
    """Texts of equal length and first word, but another middle, give other weights; each token is in one step."""
    rng = random.Random(31)
    one = prose(rng, 20_000).split()
    other = one[:9_000] + ["zebra"] * 500 + one[9_500:]
    top = np.sort(lm.token_ids(np.frombuffer(b"the of zebra", np.uint8), np.array([0, 12]))[0][:3])
    model = lm.LanguageModel(top, np.ones(3), np.ones(lm.LEAVES), np.ones(lm.LEAVES), 1, 1)
    weights = []
    for ws in (one, other):
        seen, w = weights_of(model, [" ".join(ws), "", "a few words", " "])
        assert seen == {20_000 + 1 + 1 + 3 + 1 + 1}
        weights.append(w)
    assert weights[0] != weights[1]


def test_every_training_document_is_in_one_round(spark, monkeypatch):
    """The tokens seen in all rounds, by the tasks' own count, are those of the training rows; means meet in a tree."""
    made = []
    keep = lm.written
    monkeypatch.setattr(lm, "written", lambda df, name: made.append(keep(df, name)) or made[-1])
    monkeypatch.setattr(lm, "_FAN", 2)
    rng = random.Random(33)
    df = spark.createDataFrame([(i, prose(rng, rng.randrange(0, 60))) for i in range(200)], "doc_id long, text string").repartition(7)
    rows, _, model = lm.fit(df, F.col("doc_id") % 3 != 0)
    tokens = sum(len(words_of(r["text"])) + 1 for r in rows.where("learn").collect())
    assert tokens == model.train_tokens
    weights = [x for x in made if "task" in x.columns]
    first = [x.where("kind = 0 AND part = 0") for x in weights]
    sizes = [x.count() for x in first]
    assert max(sizes) > 2 and sizes.count(1) == lm.ROUNDS and all(b <= a / 2 + 1 or a == 1 for a, b in zip(sizes, sizes[1:], strict=False))
    assert sum(x.agg(F.sum("seen")).first()[0] for x, n in zip(first, sizes, strict=True) if n == 1) == tokens


def test_scores_by_brute_force(spark):
    """The score of each text, word by word, from the weights and counts that were learned."""
    rng = random.Random(34)
    data = [(i, prose(rng, rng.randrange(0, 40))) for i in range(120)] + [(120, None), (121, " ")]
    rows, words, model = lm.fit(spark.createDataFrame(data, "doc_id long, text string"), F.col("doc_id") % 4 != 0)
    w, w_slot = (x[:, :-1].astype(float) for x in model.state)
    ident = lambda ws: [*(int(lm.token_ids(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())]))[0][0]) for x in ws), int(lm.END)]
    counts = Counter(t for i, text in data if i % 4 for t in ident(words_of(text)))
    top = [int(t) for t in model.top]
    assert sorted(counts.values())[-len(top) :] == sorted(counts[t] for t in top)
    cls = lambda t: top.index(t) if t in top else lm.TOP + (t & 15)
    leaf = lambda t: t & (lm.LEAVES - 1)
    rest = [t for t in counts if t not in top]

    def softmax(z, k):
        return z[k] - max(z) - math.log(sum(math.exp(x - max(z)) for x in z))

    def score(text):
        total, before = 0.0, []
        for t in ident(words_of(text)):
            c = [cls(before[-k]) if len(before) >= k else lm.CLASSES for k in (1, 2, 3, 4)]
            h = [int(lm.mix(np.array([before[-k]], np.uint64))[0]) >> 40 if len(before) >= k else 0 for k in (1, 2)]
            two, side, low = c[0] * 49 + c[1], 49 * 49, 4095
            at = [two, side + (h[0] >> 12), side + 4096 + (h[1] >> 12), side + 8192 + c[2] * 49 + c[3], -1]
            total += softmax(sum(w[i] for i in at), cls(t)) / math.log(10)
            if t not in top:
                s = t & 15
                at = [(two * 16 + s) * 0x9E3779B1 >> 15 & low, 4096 + ((h[0] ^ s * 2654435761) & low), 8192 + ((h[1] ^ s * 2654435761) & low), 3 * 4096 + s]
                total += softmax(sum(w_slot[i] for i in at), t >> 4 & 31) / math.log(10)
                own = [x for x in rest if leaf(x) == leaf(t)]
                total += math.log10((counts[t] + 1) / (sum(counts[x] for x in own) + len(own) + 1))
            before.append(t)
        return total

    got = {r["doc_id"]: r["score"] for r in lm.score_rows(rows, words, model).collect()}
    assert len(got) == len(data) and all(math.isclose(got[i], score(text), abs_tol=1e-3) for i, text in data)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    for n, k in ((lm.ROWS, lm.CLASSES), (lm.SLOT_ROWS, lm.SLOTS)):
        w = rng.normal(size=(n, k)).astype(np.float32)
        feats = np.stack([rng.integers(0, n, 50) for _ in range(4)])
        assert np.allclose(sum(np.exp(lm.log_probabilities(w, feats, np.full(50, y))) for y in range(k)), 1, atol=1e-5)


def test_word_hashes_tell_words_apart(monkeypatch):
    import quern.llm.common as common

    text = (prose(random.Random(4), 3000) + " " + "z" * 5000).encode()
    raw = np.frombuffer(text, np.uint8)
    s, e, _ = word_spans(raw, np.array([0, len(raw)]))
    words = text.split()
    assert [text[a:b] for a, b in zip(s, e, strict=True)] == words
    h = word_hashes(raw, s, e)
    assert len(set(h.tolist())) == len(set(words))
    monkeypatch.setattr(common, "_BLOCK", 64)
    assert np.array_equal(h, word_hashes(raw, s, e))


def test_pairs_in_linear_time():
    rng = np.random.default_rng(2)
    m = quality.FactorisationMachine(0.3, rng.normal(size=9), rng.normal(size=(9, 4)), np.zeros(1), np.ones(1))
    x = rng.normal(size=(5, 9))
    slow = [0.3 + r @ m.w + sum((m.v[i] @ m.v[j]) * r[i] * r[j] for i in range(9) for j in range(i)) for r in x]
    assert np.allclose(m.raw(x), slow)


def test_held_out_accuracy(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    q = quality.op5_quality(spark, folder).join(labels, "doc_id").where("held_out")
    assert q.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] >= 0.93
    found = language.op10_language(spark, folder).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] >= 0.95
    assert found.where("score < 0 OR score > 1").count() == 0


def test_ftrl_drops_what_does_not_tell():
    rng = np.random.default_rng(7)
    data = [(np.array([y, 2 + rng.integers(0, 50)]), np.array([1.0, 1.0]), y) for y in rng.integers(0, 2, 400)]
    w, _ = language.ftrl(data, 2, l1=1.0)
    assert (w[0, 0] > 0.5 and w[1, 1] > 0.5) and np.mean(w[2:52] == 0) > 0.5
    assert language.fit_temperature(np.array([[9.0, 0.0], [9.0, 0.0], [0.0, 9.0]]), np.array([0, 1, 1])) > 1
