"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gradeloom.llm import bpe, bpe_fst, common, decontaminate, langid, lm, minhash, packed, pii, secrets, token_files
from gradeloom.llm.components import components
from gradeloom.llm.shingles import distinct, overlap

AKIA = "AKIA" + "QWERTY1234567890AB"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
BASE = [f"word{i}" for i in range(120)]


def edited(*places):
    return " ".join("other%d" % i if i in places else w for i, w in enumerate(BASE))


TEXTS = [
    None, "", " \t\n", "one two", "ONE two", "one two three four five", " ".join(BASE), edited(3), edited(3, 40), edited(3, 40, 80), edited(7, 50, 90), " ".join(BASE).upper(),
    LONG, LONG + " end", "Ünïcödé 日本 text with ÀÉ and 😀 marks", f'token = "abcdef123456" and {AKIA} deadbeefdeadbeefdeadbeef00', "password: ab secret: abcdef token=token: abcdef",
    "mail me@example.com or a@b.c_d@e.fg at 10.0.0.1 and 300.1.1.1 card 4111 1111 1111 1111 12 call +1 (743) 555-3824 now", "1234-5678-9012-3456-7890-12", "+1 23",
    "client_id: bob-the-app http://db.example.com/x pwd = hunter22 end", "hello http://clean.example.com/page end",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with ids out of order, a repeated row, a row without an id, and columns of clashing names."""
    rows = [(i * 7 % 101, t, "en" if i % 2 else None, "rid", "base") for i, t in enumerate(TEXTS)]
    rows += [rows[7], (None, "no id at all here today", "en", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, rid string, base string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def rows_of(df):
    return df.collect()


def test_words_are_split_and_lowered_like_the_contract():
    for t in [t for t in TEXTS if t]:
        plain = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        assert [w.decode() for w in common.words(t)] == plain
    assert common.words(None) == []


# 3


def brute_components(ids_texts):
    sets = {}
    for i, t in ids_texts:
        w = common.words(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both and 100 * both >= 85 * either:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_are_those_of_brute_force(docs):
    held = {(r.doc_id, r.text) for r in rows_of(docs) if r.doc_id is not None}
    want = brute_components(held)
    got = rows_of(minhash.near_duplicates(docs))
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])


def test_large_group_of_near_copies(spark):
    random.seed(5)
    rows = []
    for i in range(160):
        w = list(BASE)
        for p in random.sample(range(120), i % 5):
            w[p] = f"own{i}x{p}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(BASE[:60] + [f"d{i}z{j}" for j in range(90)])) for i in range(60)]
    got = {r.doc_id: r.component_id for r in rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()}


def test_empty_tables(none, spark):
    benchmark = spark.createDataFrame([(1, "some words that are an item of a benchmark")], "item_id long, text string")
    assert rows_of(minhash.near_duplicates(none)) == []
    assert rows_of(secrets.find(none)) == []
    assert rows_of(pii.find(none)) == []
    assert rows_of(bpe.encode(none)) == []
    assert rows_of(decontaminate.contaminated(none, benchmark)) == []
    assert rows_of(decontaminate.contaminated(none, benchmark.limit(0))) == []
    assert rows_of(langid.identify(none, langid.train(none))) == []
    assert rows_of(lm.score(none, none)) == []
    folder = common.shared_path(spark, "none")
    assert rows_of(token_files.read(token_files.write(none, folder), folder)) == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (400, 400)], "a long, b long")
    got = {r.node: r.component for r in rows_of(components(edges))}
    assert got == {i: 0 for i in range(101)} | {400: 400, 500: 400}


def test_overlap_of_sets():
    a, b = distinct(common.words(LONG)), distinct(common.words(LONG + " more words at the very end"))
    assert overlap(a, b) == len(set(a.tolist()) & set(b.tolist()))


# 2 and 8


def base_secrets(t):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        out += [(m.start(), 0, m.end(), "assign")] * (len(m[2]) >= 6)
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def luhn(s):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(s))) % 10 == 0


def base_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def random_texts():
    random.seed(11)
    bits = ["token", "=", ":", " ", '"', "secret", "api_key", "AKIA", "ABCD1234", "0a1b2c3d4e5f", "deadbeef" * 3, "x", "\n", "é", "😀", "PassWord", "_", "@", ".", "com", "1", "12", "255", "4111111111111111", "-", "+", "(", ")", "%"]
    return ["".join(random.choice(bits) for _ in range(random.randint(0, 60))) for _ in range(400)]


def test_base_spans_on_random_texts(spark):
    texts = random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from gradeloom.llm import native
    from pyspark.sql import functions as F

    for find, brute in ((secrets.find, base_secrets), (pii.find, base_pii)):
        got = {r.doc_id: r.told for r in rows_of(find(df, keep=["doc_id"]).select("doc_id", native.told(F.col("base")).alias("told")))}
        assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_weak_parts_need_company(docs):
    got = {r.doc_id: [(s.kind, s.start) for s in r.spans] for r in rows_of(secrets.find(docs, keep=["doc_id", "rid"]))}
    with_parts = TEXTS.index(next(t for t in TEXTS if t and t.startswith("client_id")))
    clean = TEXTS.index(next(t for t in TEXTS if t and t.startswith("hello")))
    assert {k for k, _ in got[with_parts * 7 % 101]} == {"account", "endpoint", "labelled"}
    assert got[clean * 7 % 101] == []


def test_far_parts_are_not_linked(spark):
    far = "client_id: bob-the-app" + " x" * 400 + " pwd = hunter22"
    r = rows_of(secrets.find(spark.createDataFrame([(1, far)], "doc_id long, text string")))[0]
    assert r.spans == []


def test_secrets_of_linked_credentials_in_common_forms(spark):
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    storage = "Eby8vdM02xNOcqFlqUwJPLlmEtlCDXJ1OUzFT50uSRZ6IFsuFq2UVErCz4I6tq" + "/K1SZFPTOtr/KBHBeksoGMGw=="
    huge = "Ab3/" * 1500
    far = "client_id: bob-the-app" + " x" * 400
    texts = [
        f"{AKIA} aws_secret_access_key={key}", f"{AKIA}\nFOO={key}\n", f'{{"id": "{AKIA}", "SecretAccessKey": "{key}"}}', f"{AKIA} access_key = {key}",
        f"AccountName=store;AccountKey={storage};EndpointSuffix=core", f'login: bob blob "{storage}"', f"private_key={huge} login: bob", f"{huge} login: bob", f"login: bob X={huge}",
    ]
    assert len(storage) == 88
    out = {r.doc_id: r.text for r in rows_of(secrets.redact(spark.createDataFrame([*enumerate(texts), (99, far + f" {key}")], "doc_id long, text string")))}
    assert not [i for i in range(len(texts)) for s in (key, storage[:40], storage[-12:], "Ab3/") if s in out[i]]
    assert key in out[99]
    spans = [s for r in rows_of(secrets.find(spark.createDataFrame([(1, texts[7])], "doc_id long, text string"))) for s in r.spans]
    assert [(s.kind, s.start, s.end) for s in spans] == [("random", 0, 6000), ("account", 6001, 6011)]


def test_redaction_keeps_rows_and_columns(docs):
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    kept = {r.text for r in rows_of(out)}
    assert 'token = "abcdef123456"' not in " ".join(t or "" for t in kept) and None in kept
    assert "<SECRET>\" and <SECRET> <SECRET>" in kept


def test_pii_learns_from_votes(spark):
    rows = [(i, f"please call my phone (555) 234-{1000 + i} today") for i in range(30)] + [(100 + i, f"#/(055) 134-{1000 + i}/# order") for i in range(30)]
    got = {r.doc_id: [s.kind for s in r.spans] for r in rows_of(pii.find(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert all(got[i] == ["localphone"] for i in range(30)) and not any(got[100 + i] for i in range(30))


# 6


def test_language_filter(spark):
    en, de = "the quick brown fox jumps over the lazy dog and runs", "der schnelle braune fuchs springt über den faulen hund und läuft"
    rows = [(i, f"{en} {i}", "en") for i in range(20)] + [(100 + i, f"{de} {i}", "de") for i in range(20)] + [(200, None, "en"), (201, "12 34 !!", "de"), (202, "the fox", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in rows_of(langid.identify(df, model))}
    assert all(got[i][0] == "en" and got[100 + i][0] == "de" for i in range(20)) and got[202][0] == "en"
    assert got[200] == ("und", 0.0) and got[201] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    assert {r.doc_id for r in rows_of(langid.keep_known(df, model))} == set(got) - {200, 201}


def test_filter_has_no_false_negatives_and_few_false_positives():
    random.seed(2)
    words = ["".join(random.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    grams = np.unique(langid.grams(" ".join(words)))
    f = langid.build([("xx", grams), ("yy", grams[:10])])
    assert f.hits(grams)[0] == len(grams)
    other = np.unique(langid.grams(" ".join("".join(random.choice("pqrstuvwxyz") for _ in range(6)) for _ in range(3000))))
    assert f.hits(other)[0] <= 0.02 * len(other)


# 9


def test_contamination(spark, docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six"
    w = item.split()
    texts = [f"before it {item.upper()} and after", " ".join(w[:-1] + ["changed"]), " ".join(w[:15] + w[16:]), "unrelated words only in here", None, "", " ".join(w[::-1]), item + " " + item, LONG + " " + item]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, item), (8, None), (9, "tiny item"), (7, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in rows_of(decontaminate.contaminated(df, benchmark))}
    assert set(got) == {(0, 7), (1, 7), (7, 7), (8, 7)}
    assert got[0, 7].similarity == 1.0 and got[0, 7].first_word == 2 and got[7, 7].first_word == 0
    assert {r.doc_id for r in rows_of(decontaminate.clean(df, benchmark))} == {2, 3, 4, 5, 6}


def test_multi_index_finds_all_within_the_radius():
    random.seed(4)
    index = decontaminate.ItemIndex([(i, " ".join(random.choice("abcdefgh") * 3 for _ in range(20))) for i in range(40)])
    prints = np.array([[random.getrandbits(16) for _ in range(8)] for _ in range(50)], dtype=np.uint16)
    near = index.prints[np.arange(50) % 40].copy()
    for row in near:
        for bit in random.sample(range(128), 30):
            row[bit // 16] ^= np.uint16(1 << (bit % 16))
    prints = np.concatenate([prints, near])
    want = {(w, k) for w in range(100) for k in range(40) if int(np.bitwise_count(prints[w] ^ index.prints[k]).sum()) <= decontaminate.RADIUS}
    w, k = index.near(prints, np.arange(40))
    assert set(zip(w.tolist(), k.tolist(), strict=True)) == want and len(want) >= 50


# 10 and 7


def test_bpe_is_that_of_the_library(docs):
    import tiktoken

    ref = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe_fst.read_ranks(bpe.RANKS), special_tokens={})
    outputs = ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")
    texts = sorted(((r.doc_id or -1), r.text or "") for r in rows_of(docs))
    got = sorted(rows_of(bpe.encode(docs, outputs=outputs)), key=lambda r: ((r.doc_id or -1), r.decoded))
    for (_, t), r in zip(texts, got, strict=True):
        ids = ref.encode_ordinary(t)
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == t
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    back = {r.decoded for r in rows_of(bpe.decode(bpe.encode(docs)))}
    assert back == {t for _, t in texts}


def test_transducer_streams_and_matches_the_definition():
    random.seed(1)
    encoder, decoder, _ = bpe_fst.codec(bpe.RANKS, bpe.PATTERN)
    machine = encoder.machine
    for _ in range(600):
        data = "".join(random.choice(["a", "th", "e", "ü", "ß", "日", "😀", "12", "!!", "ing", "xxx", "é"]) for _ in range(random.randint(1, 12))).encode()
        want = tuple(machine.merged(data))
        assert machine.encode(data) == want and tuple(x for out in machine.steps(data) for x in out) == want
    broken = [machine.ranks[bytes([b])] for b in b"a\xe6\x97\xe6\x97\xa5\xff\xc3"]
    assert "".join(decoder.stream(broken)) == b"a\xe6\x97\xe6\x97\xa5\xff\xc3".decode("utf-8", "replace")


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_packing_round_trip_and_random_access(bits):
    random.seed(bits)
    lists = [np.array([random.getrandbits(bits) for _ in range(n)], dtype=np.uint32) for n in (0, 1, 5, 70_000, 3, 0, 66_000)]
    w = packed.Writer(bits)
    for i, ids in enumerate(lists):
        w.add(None if i == 2 else i, ids)
    r = packed.Reader(w.finish())
    assert r.docs == [0, 1, None, 3, 4, 5, 6] and r.n_ids == sum(map(len, lists))
    for k in (6, 0, 3, 2, 1, 4, 5):
        assert np.array_equal(r.document(k), lists[k])
    flat = np.concatenate(lists)
    assert np.array_equal(r.ids(65_000, 72_000), flat[65_000:72_000])


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.TOKENIZER)
    folder = common.shared_path(spark, "token-files")
    got = sorted(rows_of(token_files.read(token_files.write(docs, folder), folder)), key=lambda r: r.start)
    held = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in rows_of(docs)))
    start = 0
    for (known, i, text), r in zip(held, got, strict=True):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i if known else None, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_word_encoder_on_odd_texts():
    random.seed(3)
    w = token_files.WordEncoder(token_files.TOKENIZER)
    bits = ["a", "Th", "É", "é", " ", "\n", "'s", "'", "<|endoftext|>", "\x1c", "\x85", "　", "1", "23", "!!", "İ", "ΑΣ", "日本", "😀", "ﬁ", "́", "a.b", "_._", ",", "."]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 30))) for _ in range(800)]
    want = [e.ids for e in w.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in w.encode(texts)] == want


# 4


def test_language_model(spark, docs):
    train = docs.where("doc_id % 3 <> 0 OR doc_id IS NULL")
    counts = Counter()
    for r in rows_of(train):
        counts.update(common.words(r.text))
        counts[b" "] += 1
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows_of(docs):
        tokens = [*common.words(r.text), b" "]
        base = sum(np.log10((counts.get(t, 0) + 1) / (n + v + 1)) for t in tokens)
        want[r.doc_id, len(tokens), sum(t in counts for t in tokens), round(base, 6)] += 1
    got = rows_of(lm.score(docs, train))
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and np.isfinite(r.score) and r.train_tokens == n for r in got)


def test_cold_tokens_count_like_hot_ones(spark, docs, monkeypatch):
    train = docs.where("doc_id % 3 <> 0")
    key = lambda r: (r.doc_id or -1, r.n_tokens)
    hot = sorted(rows_of(lm.score(docs, train)), key=key)
    monkeypatch.setattr(lm, "HOT", 5)
    cold = sorted(rows_of(lm.score(docs, train)), key=key)
    for a, b in zip(hot, cold, strict=True):
        assert (a.doc_id, a.n_tokens, a.n_known) == (b.doc_id, b.n_tokens, b.n_known)
        assert abs(a.base_score - b.base_score) < 1e-6 and abs(a.score - b.score) < 1e-3 * abs(a.score)


def test_transducer_on_many_pieces_and_long_ones():
    random.seed(2)
    machine = bpe_fst.MergeTransducer(bpe_fst.read_ranks(bpe.RANKS))
    pieces = ["".join(random.choice(["a", "th", "e", "ü", "日", "ing", "x"]) for _ in range(random.choice([1, 3, 9, 400]))).encode() for _ in range(60)]
    ids, sizes = machine.encode_all(pieces)
    cut = [tuple(x.tolist()) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert cut == [tuple(machine.merged(p)) for p in pieces] and max(map(len, pieces)) > bpe_fst.LONG
    assert machine.encode_all([])[0].tolist() == []


def test_tokens_come_before_the_end_of_a_piece():
    """Emission needs bounded lookahead only: long before a piece of 3,000 letters ends, its first tokens are out."""
    machine = bpe_fst.MergeTransducer(bpe_fst.read_ranks(bpe.RANKS))
    out = list(machine.steps(b"theinging" * 333))
    assert sum(map(len, out[:300])) > 20


def test_bpe_of_other_patterns(spark):
    import tiktoken

    pattern = r"[a-z]+|[^a-z]+"
    ref = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe_fst.read_ranks(bpe.RANKS), special_tokens={})
    texts = ["ab cd  ef", " x", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: list(r.ids) for r in rows_of(bpe.encode(df, pattern=pattern))} == {i: ref.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_decoding_of_broken_ids(spark):
    machine = bpe_fst.codec(bpe.RANKS, bpe.PATTERN)[0].machine
    data = [b"a\xe6\x97 b", b"\xe6\x97\xa5", b"\xff", b""]
    ids = [[machine.ranks[bytes([b])] for b in x] for x in data]
    decoder = bpe_fst.codec(bpe.RANKS, bpe.PATTERN)[1]
    flat, ends = np.array([i for x in ids for i in x]), np.cumsum([0, *map(len, ids)])
    raw, at = decoder.decode_batch(flat, ends)
    assert [bytes(raw[i:j]).decode() for i, j in zip(at, at[1:])] == [x.decode("utf-8", "replace") for x in data]


def test_token_files_are_read_by_several_tasks(spark, docs, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 50)
    folder = common.shared_path(spark, "token-files")
    files = token_files.write(docs, folder)
    read = token_files.read(files, folder)
    assert files.count() > 3 and read.rdd.getNumPartitions() == files.count()
    assert len(rows_of(read)) == docs.count()


def test_other_tokenizers_get_texts_whole():
    w = token_files.WordEncoder(token_files.public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Some  text here.", "", "Ünïcödé"]
    assert not w.by_word
    assert [x.tolist() for x in w.encode(texts, 7)] == [[*e.ids, 7] for e in w.library.encode_batch(texts, add_special_tokens=False)]


# truths of language ID, decontamination and the pipeline


def test_signs_are_no_letters(spark):
    model = langid.build([("fr", langid.grams("le la les des"))])
    assert [model.decide(t)[0] for t in ("²", "½ Ⅷ ①", "12", "", None, "été")] == ["und"] * 5 + ["fr"]


def test_more_languages_than_a_mask_has_bits(spark):
    random.seed(6)
    entries = [(f"l{i:03d}", np.unique(langid.grams(" ".join("".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(60))))) for i in range(130)]
    model = langid.build(entries)
    assert len(model.masks) == 3 and model.hits(entries[100][1])[100] == len(entries[100][1])
    assert int(np.argmax(model.hits(entries[129][1]))) == 129 and len(model.hits(entries[0][1])) == 130


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents")
    told = langid.query(spark, sf).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out AND lang IS NOT NULL AND text IS NOT NULL")
    n, right = told.count(), told.where("lang_pred = lang").count()
    assert n > 100 and right >= 0.95 * n


def test_unlabelled_rows_get_their_language(spark):
    en, de = "the quick brown fox jumps over the lazy dog and runs", "der schnelle braune fuchs springt über den faulen hund und läuft"
    df = spark.createDataFrame([(1, en, "en"), (2, de, "de"), (3, de, None), (4, "12", None)], "doc_id long, text string, lang string")
    model = langid.train(df)
    assert {(r.doc_id, r.lang) for r in rows_of(langid.keep_known(df, model, label="lang"))} == {(1, "en"), (2, "de"), (3, "de")}


def brute_contamination(texts, items):
    out = set()
    for d, t in texts.items():
        words = (t or "").lower().split()
        for i, item in items:
            own = (item or "").lower().split()
            window = min(len(own), len(words))
            if not window:
                continue
            bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
            want = bag(own)
            for s in range(len(words) - window + 1):
                got = bag(words[s : s + window])
                least = sum((got & want).values())
                if least >= 0.8 * (sum(got.values()) + sum(want.values()) - least):
                    out.add((d, i))
                    break
    return out


def test_contamination_is_that_of_brute_force(spark, monkeypatch):
    """Many blocks, items of all lengths and changed windows, against every window of every text."""
    random.seed(12)
    monkeypatch.setattr(decontaminate, "BLOCK", 3)
    monkeypatch.setattr(decontaminate, "KEPT", 2)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(f"i{k}", " ".join(random.choice(vocabulary) for _ in range(random.choice([1, 2, 4, 5, 8, 20, 40])))) for k in range(20)]
    texts = {}
    for d in range(60):
        words = [random.choice(vocabulary) for _ in range(random.randint(0, 60))]
        own = random.choice(items)[1].split()
        for _ in range(random.choice([0, 0, 1, 2, 5])):
            own[random.randrange(len(own))] = "changed"
        at = random.randint(0, len(words))
        texts[d] = " ".join(words[:at] + own + words[at:])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame([*items, items[0], (None, None)], "item_id string, text string")
    got = {(r.doc_id, r.item_id) for r in rows_of(decontaminate.contaminated(df, benchmark))}
    assert got == brute_contamination(texts, items)
    assert {r.doc_id for r in rows_of(decontaminate.clean(df, benchmark))} == set(texts) - {d for d, _ in got}


def test_contamination_of_a_long_text_that_repeats_a_passage(spark):
    item = " ".join(f"p{i}" for i in range(200))
    df = spark.createDataFrame([(1, " ".join([item] * 300)), (2, LONG)], "doc_id long, text string")
    got = rows_of(decontaminate.contaminated(df, spark.createDataFrame([("x", item)], "key string, words string"), item="key", item_text="words"))
    assert [(r.doc_id, r.item_id, r.similarity, r.first_word) for r in got] == [(1, "x", 1.0, 0)]
