"""Text operators against libraries, brute force and held-out rows, and on awkward tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from plain import brute_links, pii_base, secret_base
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from credence.llm import bpe, jaccard, langid, packing, pii, quality, secrets, token_store
from credence.llm.common import fresh_path
from credence.llm.components import connected_components
from credence.llm.textvec import Scan, split_words
from credence.llm.vocab import word_tokenizer

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n\n a\n", "a'st it's 's ''s we've x'll  12 3a\n\n b...'d", "<|endoftext|> a<|startoftext|>b", "ÇA É ﬁ Σας ΟΔΟΣ İstanbul", "日本語 text 한국어",
    "é x", "\0 a\0b", "don't'S 'RE", "a b c\u0085d　x", "x" * 5000, " 's", "a  's", " '", "😀😀 x🙂", "Ab1 " * 3000,
]


def random_texts(n=3000, seed=1):
    r = random.Random(seed)
    alphabet = "abcdefghijklmnop '\n\tABÇéß12 .,!日本😀 ’-_"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(n)]


def docs_frame(spark, texts, ids=None):
    """Documents with clashing extra columns."""
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "k", 1) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kind string, length int")


def test_word_ids_equal_the_library():
    texts = ODD + random_texts()
    tok = word_tokenizer(WORD)
    for t, ids in zip(texts, tok.encode(texts)):
        assert tok.library.encode(t, add_special_tokens=False).ids == ids.tolist(), t


def test_word_cache_may_overflow():
    from credence.llm.vocab import WordTokenizer

    tok = WordTokenizer(WORD)
    tok.cache.limit = 5
    for _ in range(3):
        for t, ids in zip(ODD, tok.encode(ODD)):
            assert tok.library.encode(t, add_special_tokens=False).ids == ids.tolist()


def test_bpe_equals_the_library_and_round_trips():
    c, lib = bpe.coder(BYTE), Tokenizer.from_file(BYTE)
    texts = ODD + random_texts(seed=2)
    for t, ids in zip(texts, c.encode(texts)):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want, t
        assert c.decode(ids) == lib.decode(want, skip_special_tokens=False)
    assert c.decode(np.array([10**6, c.id_of[b"a"]])) == "a"


def test_bpe_frame(spark):
    df = docs_frame(spark, [None, "", "hello world", "hello world"])
    rows = bpe.encode_documents(df, BYTE, with_ids=True).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in rows] == [0, 0, 2, 2] and rows[2]["decoded"] == "hello world"
    assert rows[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest() == rows[1]["decoded_sha256"]
    assert bpe.encode_documents(df.limit(0), BYTE).count() == 0


# --- files -----------------------------------------------------------------------------------------------------------------


def test_store_round_trip(spark):
    texts = [None, "", *random_texts(60), "long " * 3000, "same", "same"]
    ids = [*range(len(texts) - 1, 1, -1), 0, 0]
    df = docs_frame(spark, texts, ids).union(docs_frame(spark, ["no id"], [None]))
    m = token_store.write_store(df.select("doc_id", "text"), fresh_path(spark, "t"), WORD, shards=3)
    rows = token_store.read_store(m, with_ids=True).join(token_store.shard_starts(m), "shard").selectExpr("doc_id", "shard_start + start_in_shard as start", "n_tokens", "ids_crc32", "ids").orderBy("start").collect()
    assert len(rows) == len(texts) + 1
    order = [(-1 if r["doc_id"] is None else r["doc_id"]) for r in rows]
    assert order == sorted(order)
    at = 0
    lib = word_tokenizer(WORD).library
    by = {}
    for i, t in zip(ids, texts):
        by.setdefault(i, []).append(t)
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        if r["doc_id"] is not None:
            assert r["ids"] in [[*lib.encode(t or "", add_special_tokens=False).ids, 1] for t in by[r["doc_id"]]]
    few = token_store.read_store(m, {5, 7}).collect()
    assert sorted(r["doc_id"] for r in few) == [5, 7]
    empty = token_store.write_store(df.select("doc_id", "text").limit(0), fresh_path(spark, "t"), WORD)
    assert token_store.read_store(empty).count() == 0


def test_store_notices_damage():
    import io

    sink = io.BytesIO()
    w = token_store.ShardWriter(sink, frame_bytes=64)
    for k in range(9):
        w.add(k, np.arange(k * 5, k * 5 + 11, dtype=np.uint32))
    w.close()
    data = bytearray(sink.getvalue())
    fetch = lambda d: lambda a, n: bytes(d[a : a + n])
    r = token_store.ShardReader(fetch(data), len(data))
    assert [x[2].tolist() for x in r.documents({3})] == [list(range(15, 26))] and len(r.table) > 3
    r.table[0, 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(r.documents({0}))


# --- packing ---------------------------------------------------------------------------------------------------------------


def check_packing(rows: pd.DataFrame, capacity: int):
    rows = rows.sort_values(["sequence_id", "offset"])
    ends = rows.groupby("sequence_id")["length"].cumsum()
    assert (ends - rows["length"] == rows["offset"]).all() and ends.max() <= capacity


def test_pack_documents(spark):
    texts = [None, "", *random_texts(300), "word " * 9001, "same", "same"]
    cut = packing.pieces(docs_frame(spark, texts), WORD).persist()
    out = packing.pack(cut, shard_pieces=100).toPandas()
    check_packing(out, 4096)
    assert len(out) == cut.count()
    long = out[out["doc_id"] == len(texts) - 3].sort_values("piece")
    assert long["length"].tolist()[:-1] == [4096] * (len(long) - 1) and long["start"].tolist() == [4096 * k for k in range(len(long))]
    bound = math.ceil(out["length"].sum() / 4096)
    assert out["sequence_id"].nunique() <= bound + 2
    assert packing.pack(cut.limit(0)).count() == 0


def test_repeated_ids_are_packed_apart(spark):
    out = packing.pack(packing.pieces(docs_frame(spark, ["same text", "same text", "other text", None], [4, 4, 4, None]), WORD)).toPandas()
    check_packing(out, 4096)
    assert len(out) == 4 and out["sequence_id"].nunique() == 1


def fewest_bins(sizes, capacity):
    """The optimum, by trying every place for each piece, long ones first."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(k, room):
        if len(room) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(room)
            return
        for i in {r: i for i, r in enumerate(room)}.values():
            if room[i] >= sizes[k]:
                place(k + 1, [*room[:i], room[i] - sizes[k], *room[i + 1 :]])
        place(k + 1, [*room, capacity - sizes[k]])

    place(0, [])
    return best[0]


def test_evolution_equals_the_optimum_on_small_sets_and_beats_best_fit():
    r = random.Random(3)
    beaten = 0
    for k in range(12):
        items = [x for _ in range(4) for a in [r.randint(34, 45)] for x in (a, 30, 70 - a)] if k % 2 else [r.randint(15, 60) for _ in range(11)]
        lengths, want = np.array(items), fewest_bins(items, 100)
        plain = len(packing.best_fit(sorted(items, reverse=True), [], 100))
        got = packing.evolve(packing.start_population(lengths, 100, 8, r), lengths, 100, 60, r)[0]
        assert len(got) == want <= plain and sorted(v for b in got for v in b) == sorted(items)
        beaten += want < plain
    for seed in range(3):  # three pieces fill a bin exactly
        r = random.Random(seed)
        items = [x for _ in range(30) for a in [r.randint(380, 490)] for b in [r.randint(250, 750 - a)] for x in (a, b, 1000 - a - b)]
        plain = len(packing.best_fit(sorted(items, reverse=True), [], 1000))
        rng = random.Random(2)
        got = packing.evolve(packing.start_population(np.array(items), 1000, 20, rng), np.array(items), 1000, 80, rng)[0]
        assert 30 <= len(got) <= plain - 2


def test_islands_beat_best_fit_in_a_whole_run(spark):
    r = random.Random(1)
    items = [x for _ in range(60) for a in [r.randint(1560, 2000)] for b in [r.randint(1024, 3072 - a)] for x in (a, b, 4096 - a - b)]
    df = spark.createDataFrame([(i, 0, 0, x, i) for i, x in enumerate(items)], packing.PIECES)
    out = packing.pack(df).toPandas()
    check_packing(out, 4096)
    assert 60 <= out["sequence_id"].nunique() < len(packing.best_fit(sorted(items, reverse=True), [], 4096))


def test_crossover_keeps_every_piece_and_capacity():
    rng = random.Random(3)
    lengths = np.sort(np.array([rng.randint(1, 60) for _ in range(200)]))
    pop = packing.start_population(lengths, 100, 4, rng)
    assert pop
    a, b = packing.best_fit(rng.sample(lengths.tolist(), 200), [], 100), packing.best_fit(lengths.tolist(), [], 100)
    for _ in range(20):
        c = packing.crossover(a, b, lengths, 100, rng)
        assert sorted(v for x in c for v in x) == lengths.tolist() and max(map(sum, c)) <= 100
        a, b = b, c
    assert packing.from_genes(packing.to_genes(a)) == a
    best = packing.evolve([a, b, *pop], lengths, 100, 10, rng)[0]
    assert len(best) <= len(a)


# --- personal data and secrets -----------------------------------------------------------------------------------------------

def pii_texts():
    r = random.Random(9)
    bits = ["a@b.co", "x.y+z@q-r.s.t", "@", "..", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "+99999999999999999", "é😀", " ", "-", "_", "12", "7 7", "%", "word"]
    return ["".join(r.choice(bits) for _ in range(r.randint(1, 12))) for _ in range(1500)]


def test_pii_rules_equal_the_patterns(spark):
    texts = [None, "", *pii_texts(), "9" * 30000, "a." * 9000 + "@b." + "c." * 9000 + "d", "1 " * 20000, "+1" + "-" * 30000, "call (030) 123 4567 IBAN DE89 3704 0044 0532 0130 00 joe [at] mail [dot] com"]
    found = pii.find_personal_data(docs_frame(spark, texts), ["doc_id"]).select("doc_id", pii.joined(pii.F.col("base")).alias("b"), pii.joined(pii.F.col("spans")).alias("s"))
    got = {r["doc_id"]: r for r in found.collect()}
    for i, t in enumerate(texts):
        assert got[i]["b"] == pii_base(t or ""), t
        assert set(filter(None, got[i]["b"].split(","))) <= set(got[i]["s"].split(","))
    last = got[len(texts) - 1]["s"]
    assert "iban:" in last and "tel:" in last and "mail:" in last
    assert pii.find_personal_data(docs_frame(spark, texts).limit(0), ["doc_id"]).count() == 0


def test_pii_redaction(spark):
    found = docs_frame(spark, ["mail a@b.co now"]).withColumn("spans", pii.F.expr("array(named_struct('a', 5, 'b', 11, 'kind', 0))"))
    assert found.select(pii.redact(pii.F.col("text"), pii.F.col("spans")).alias("t")).first()["t"] == "mail [EMAIL] now"


def test_boosting_separates():
    table = [((k, d, 0, c, x, 0), 0.0 if c and x else 9.0, 9.0 if c and x else 0.0) for k in range(3) for d in range(4) for c in (0, 1) for x in (0, 1)]
    trees = pii.boost(table, rounds=12)
    for row, _, pos in table:
        assert (sum(pii.tree_value(t, row) for t in trees) > 0) == (pos > 0)


def valid_iban(r, land="DE", n=18):
    rest = "".join(r.choice("0123456789") for _ in range(n))
    for check in range(2, 99):
        whole = f"{land}{check:02d}{rest}"
        if int("".join(str(int(c, 36)) for c in whole[4:] + whole[:4])) % 97 == 1:
            return whole


def test_planted_personal_data_is_selected_and_other_numbers_are_not(spark):
    r = random.Random(21)
    prose = lambda n: " ".join(r.choice(ENGLISH) for _ in range(n))
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    personal = {
        "mail": lambda: ("", f"{r.choice(ENGLISH)}.{r.choice(ENGLISH)} [at] {r.choice(ENGLISH)} [dot] {r.choice(['com', 'org', 'de', 'net'])}"),
        "tel": lambda: (r.choice(["call me: ", "my phone is ", "Tel. "]), r.choice([f"(0{d(2)}) {d(3)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"{r.randint(201, 989)}-{d(3)}-{d(4)}"])),
        "ssn": lambda: (r.choice(["her SSN is ", "Social security number: "]), f"{d(3)}-{d(2)}-{d(4)}"),
        "iban": lambda: (r.choice(["", "IBAN "]), valid_iban(r)),
        "ip6": lambda: ("", ":".join("%x" % r.getrandbits(16) for _ in range(8))),
    }
    other = {
        "mail": lambda: ("", f"{r.choice(ENGLISH)} [at] {r.choice(ENGLISH)} [dot] {r.choice(['together', 'mountain'])}"),
        "tel": lambda: (r.choice(["order ", "serial no. ", "item "]), f"{r.randint(201, 989)}-{d(3)}-{d(4)}"),
        "ssn": lambda: (r.choice(["part ", "invoice no. "]), f"{d(3)}-{d(2)}-{d(4)}"),
        "iban": lambda: ("", "XY99" + d(16)),
        "ip6": lambda: (r.choice(["at ", ""]), ":".join("%02d" % r.randrange(60) for _ in range(6))),
    }
    texts, want = [], []
    for made, yes in ((personal, True), (other, False)):
        for kind in made:
            for _ in range(60):
                lead, x = made[kind]()
                text = prose(12) + " " + lead
                want.append((f"{kind}:{len(text)}:{len(text) + len(x)}", kind, yes))
                texts.append(text + x + " " + prose(9))
    spans = {x["doc_id"]: x["s"] for x in pii.find_personal_data(docs_frame(spark, texts), ["doc_id"]).select("doc_id", pii.joined(F.col("spans")).alias("s")).collect()}
    for kind in personal:
        found = [w in spans[i].split(",") for i, (w, k, yes) in enumerate(want) if k == kind and yes]
        wrong = [any(x.startswith(kind) for x in spans[i].split(",")) for i, (_, k, yes) in enumerate(want) if k == kind and not yes]
        assert np.mean(found) >= 0.9 and np.mean(wrong) <= 0.1, (kind, np.mean(found), np.mean(wrong))


def test_spans_within_a_rules_span_are_left_out(spark):
    out = pii.find_personal_data(docs_frame(spark, ["call +49 030 123 4567 or call 030 123 4567", "a" * 10 + "@b.co"]), ["doc_id"]).orderBy("doc_id").select(pii.joined(F.col("spans")).alias("s")).collect()
    assert [x["s"] for x in out] == ["phone:5:21,tel:30:42", "email:0:15"]


def test_many_matches_take_time_in_proportion(spark):
    text = "mail a@b.co and 1.2.3.4 or call 030 123 4567; " * 20_000
    df = docs_frame(spark, [text, text]).withColumn("base", F.lit(1)).withColumn("x", F.lit("clash"))
    out = pii.find_personal_data(df, ["doc_id", "x", "base"]).select("doc_id", F.size("spans").alias("n"), F.element_at("spans", -1).alias("last")).collect()
    assert [(x["n"], x["last"]["b"]) for x in out] == [(60_000, len(text) - 2)] * 2


def test_secret_rules_and_random_tokens(spark):
    r = random.Random(5)
    key = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    bits = ["password", "PassWd", "ſecret=abcdefgh", "token", "api_key", "APIKEY", ":", "=", '"', " ", "abc123", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "ü", ".", "-"]
    prose = " ".join(r.choice(["the", "over", "running", "water", "house", "stands", "yellow", "in", "of"]) for _ in range(200))
    texts = [None, "", *("".join(r.choice(bits) for _ in range(r.randint(1, 9))) for _ in range(1200)), *(f"{prose} {key(40)} {prose}" for _ in range(40)), *(prose + " x" * k for k in range(600))]
    found = secrets.find_secrets(docs_frame(spark, texts), ["doc_id"]).collect()
    spans = {x["doc_id"]: x for x in found}
    for i, t in enumerate(texts):
        assert spans[i]["base_spans"] == secret_base(t or ""), t
    random_ = [i for i, x in spans.items() if any(s["k"] == 3 for s in x["found_spans"])]
    assert sum(1202 <= i < 1242 for i in random_) >= 36 and not any(i >= 1242 for i in random_)
    out = secrets.redact(docs_frame(spark, ["x password=abcdefgh y", None, ""])).orderBy("doc_id").collect()
    assert out[0]["text"] == "x [SECRET] y" and out[0]["n_chars"] == 12 and out[1]["text"] is None
    assert secrets.find_secrets(docs_frame(spark, ["a"]).limit(0), ["doc_id"]).count() == 0


def plain_battery(token):
    """The three p-values, step by step."""
    name, body = secrets.infer_encoding(token)
    alphabet = secrets.ALPHABETS[name]
    k, n, v = len(alphabet), len(body), [alphabet.index(c) for c in body]
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    chi = sum((v.count(x) - n / k) ** 2 for x in range(k)) / (n / k)
    uniform = tail(((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1))))
    up = sum(2 * x >= k for x in v)
    if up in (0, n):
        runs = 2.0 ** (1 - n)
    else:
        mean = 2 * up * (n - up) / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        number = 1 + sum((2 * x >= k) != (2 * y >= k) for x, y in zip(v, v[1:]))
        share = (k // 2) / k
        runs = min(2 * tail(abs(number - mean) / math.sqrt(var)) if var > 0 else 1, 2 * tail(abs(up - n * share) / math.sqrt(n * share * (1 - share))))
    m = sum(v) / n
    total = sum((x - m) ** 2 for x in v)
    serial = 2 * tail(abs(sum((x - m) * (y - m) for x, y in zip(v, v[1:])) / total + 1 / n) * math.sqrt(n)) if total else 0
    return [min(1, p) for p in (uniform, runs, serial)]


def test_battery():
    names = {"DEADBEEF00": "hex", "a-b_": "base64", "12345": "decimal", "abcxyz": "letter", "ABCXYZ": "letter", "ABC2Z": "base32", "abc2z": "base36", "aBcXyZ": "letters", "aB1": "base62", "aGVsbG8=": "base62"}
    assert {t: secrets.infer_encoding(t)[0] for t in names} == names
    r = random.Random(1)
    for name, alphabet in secrets.ALPHABETS.items():
        keys = ["".join(r.choice(alphabet) for _ in range(r.randint(16, 70))) for _ in range(150)]
        assert np.mean(np.array([secrets.level_of(x) for x in keys]) <= 8) > 0.95, name
        for x in [*keys[:40], "a" * 20, "ab" * 20, "abcdefghijklmnopqrstuvwxyz" * 2, "=" * 20, "-" * 17, "0" * 30 + "1"]:
            e, body = secrets.infer_encoding(x)
            if not body:
                continue
            v = np.array([secrets.ALPHABETS[e].index(c) for c in body])
            assert secrets.battery(v[None, :], len(secrets.ALPHABETS[e]))[0] == pytest.approx(plain_battery(x), abs=2e-4)
    assert secrets.level_of("0123456789abcdef" * 3) > 8 and secrets.level_of("aaaaaaaaaaaaaaaaaaaaaa1") > 8


ENGLISH = """the of and water house running over yellow where there night morning people because another through little world
 country still should answer found study learn plant cover food between state keep never start city earth light thought head
 under story left don while along might close something seem next hard open example begin life always those both paper together
 group often until children feet car mile walk white sea began grow took river four carry once book hear stop without second
 later miss idea enough eat face watch far really almost let above girl sometimes mountain cut young talk soon list song being""".split()


def test_controls_are_counted_piece_by_piece():
    r = random.Random(2)
    texts = [" ".join(r.choice(ENGLISH) for _ in range(r.randint(0, 300))) + " A1 b2-C3 ü" * r.randint(0, 9) for _ in range(12)] + ["", "x"]
    want = np.zeros((len(secrets.ENCODINGS) * len(secrets.LENGTH_FROM), secrets.LEVELS), int)
    for t in texts:
        for e, (name, alphabet) in enumerate(secrets.ALPHABETS.items()):
            body = [c for c in (t if name in secrets.TWO_CASES else t.lower()) if c in alphabet]
            at, turn = 0, len(t) % 7
            while at + secrets.LENGTH_FROM[turn] <= len(body):
                n = secrets.LENGTH_FROM[turn]
                v = np.array([alphabet.index(c) for c in body[at : at + n]])
                want[e * 7 + turn, secrets.levels_of(v[None, :], len(alphabet))[0]] += 1
                at, turn = at + n, (turn + 1) % 7
    assert (secrets.control_counts(texts) == want).all() and want.sum() > 100


def test_planted_keys_of_every_encoding_and_the_share_of_false_ones(spark):
    r = random.Random(9)
    prose = lambda n: " ".join(r.choice(ENGLISH) for _ in range(n))
    long_word = lambda: "".join(r.choice(ENGLISH) for _ in range(r.randint(4, 8)))
    texts, planted = [], {}
    for name, alphabet in secrets.ALPHABETS.items():
        if name == "decimal":  # no prose of digits here to tell them from
            continue
        for n in (16, 24, 32, 40, 64):
            for _ in range(20):
                key = "".join(r.choice(alphabet) for _ in range(n))
                key = key.upper() if name in ("base32", "hex") else key  # 24 lower-case hex digits are a rule's
                before = prose(40) + " "
                planted[len(texts)] = (len(before), len(before) + n, name, n)
                texts.append(before + key + " " + prose(30))
    texts += [prose(40) + " " + long_word() + " " + prose(40) + " " + "/".join(r.choice(ENGLISH) for _ in range(6)) for _ in range(1500)]
    report = {}
    found = {x["doc_id"]: [(s["a"], s["b"]) for s in x["found_spans"] if s["k"] == 3] for x in secrets.find_secrets(docs_frame(spark, texts), ["doc_id"], report).collect()}
    true = sum(i in planted and planted[i][:2] == s for i, spans in found.items() for s in spans)
    every = sum(len(spans) for spans in found.values())
    assert true >= 350 and every - true <= 0.05 * every, (true, every)
    caught = {(name, n): sum(planted[i][:2] in found[i] for i in planted if planted[i][2:] == (name, n)) for name in secrets.ALPHABETS for n in (16, 24, 32, 40, 64)}
    for name in ("hex", "base32", "base36", "letters", "base62", "base64"):
        assert [caught[name, n] >= least for n, least in ((24, 10), (32, 14), (40, 14))] == [True] * 3, (name, sorted(caught.items()))
    assert all(caught[name, 16] >= 14 for name in ("hex", "letters", "base62", "base64")), sorted(caught.items())
    assert caught["letter", 64] >= 14, sorted(caught.items())  # only letters of one case: told from long words by their length


def test_secrets_in_awkward_texts(spark):
    r = random.Random(3)
    huge = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(300_000))
    many = "password=abcdefgh " * 20_000
    df = docs_frame(spark, [huge, many, many, "=" * 5000, None]).withColumn("found", F.lit(1)).withColumn("base_spans", F.lit("x"))
    out = {x["doc_id"]: x for x in secrets.find_secrets(df.select("doc_id", "text"), ["doc_id"]).collect()}
    assert out[1]["n_assign"] == 20_000 and out[1]["found_spans"] == out[2]["found_spans"] and len(out) == 5
    red = {x["doc_id"]: x for x in secrets.redact(df).collect()}
    assert red[1]["text"] == "[SECRET] " * 20_000 and red[1]["found"] == 1 and red[4]["text"] is None


# --- near duplicates ---------------------------------------------------------------------------------------------------------


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(8)
    vocabulary = ["w%d" % i for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(30, 120))] for _ in range(25)]
    shared = [r.choice(vocabulary) for _ in range(60)]
    texts = [None, "", "...", "one two", "one two", "One, two!"]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(r.choice([0, 1, 3, 12])):
            c = list(b)
            for _ in range(r.randint(0, 4)):
                c[r.randrange(len(c))] = r.choice(vocabulary)
            texts.append(" ".join(c))
        texts.append(" ".join(shared + b[:20]))
    want = brute_links(texts)
    for block, split_rows, block_rows in ((1_000_000, 8192, 2048), (300, 8, 2048), (1_000_000, 8192, 3)):
        report = {}
        got = {x["doc_id"]: x for x in jaccard.near_duplicates(docs_frame(spark, texts), block, split_rows, block_rows, report).collect()}
        assert [(got[i]["class_id"], got[i]["n_links"]) for i in range(len(texts))] == want
        assert report["recall"] >= 0.99999
    assert all(got[i]["kept"] for i in (0, 1, 2)) and got[5]["class_id"] == 3


def test_no_link_is_lost_in_large_buckets(spark):
    r = random.Random(11)
    word = lambda: "w%d" % r.randrange(5000)
    texts = []
    for size in (100, 112, 90):  # one near-copy group of three sizes
        base = [word() for _ in range(size)] if not texts else [*texts[0].split(), *(word() for _ in range(20))][:size]
        for _ in range(40):
            c = list(base)
            for _ in range(2):
                c[r.randrange(len(c))] = word()
            texts.append(" ".join(c))
    passage = " ".join(word() for _ in range(30))
    texts += [passage + " " + " ".join(word() for _ in range(r.randint(5, 90))) for _ in range(40)]
    want = brute_links(texts)
    for block, split_rows in ((6000, 8192), (6000, 16)):
        got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jaccard.near_duplicates(docs_frame(spark, texts), block, split_rows).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_miss_rate_of_the_paths():
    n, size, common = 40_000, 90, 80  # similarity 0.8
    rng = np.random.default_rng(3)
    g = rng.integers(0, 1 << 64, (n, size + size - common), dtype=np.uint64)
    shared = np.zeros(n, bool)
    for f in jaccard._FACTORS[: jaccard.FIRST_ROOTS]:
        h = g * f
        both = h[:, :common].min(1)
        shared |= (both < h[:, common:size].min(1)) & (both < h[:, size:].min(1))
    assert (~shared).mean() < 5e-5


def test_near_duplicates_on_awkward_tables(spark):
    same = "a b c d e f g h"
    df = docs_frame(spark, [same, same, same, "q r s t u v"], [None, 3, 3, 9])
    rows = jaccard.near_duplicates(df).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1, r["n_links"]) for r in rows) == [(-1, -1, 0), (3, 3, 1), (3, 3, 1), (9, 9, 0)]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0
    two = docs_frame(spark, [same, same, same + " i j", "k l m n o p", same], [5, 6, 6, 6, 5])  # an id with different texts
    got = sorted((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in jaccard.near_duplicates(two).collect())
    assert got == [(5, 5, 2, True), (5, 5, 2, True), (6, 5, 2, False), (6, 6, 0, True), (6, 6, 0, True)]


def test_many_short_texts_with_one_line_split_and_stay_exact(spark):
    r = random.Random(12)
    line = "all of these pages end with this one line of words"
    texts = [" ".join("w%d" % r.randrange(300) for _ in range(r.randint(3, 14))) + " " + line for _ in range(1200)]
    texts += [texts[k] + " again" for k in range(0, 1200, 40)]
    want = brute_links(texts)
    report = {}
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jaccard.near_duplicates(docs_frame(spark, texts), split_rows=64, block_rows=32, report=report).collect()}
    assert [got[i] for i in range(len(texts))] == want and report["recall"] >= 0.99999


def test_estimated_recall():
    assert jaccard.estimated_recall([], 8) == 1
    assert jaccard.estimated_recall([(52, 0, 10)], 1) == pytest.approx(52 / 64)
    assert jaccard.estimated_recall([(64, 3, 10)], 4) == 1
    assert jaccard.estimated_recall([(52, 4, 10)], 4) < jaccard.estimated_recall([(52, 0, 10)], 4) < jaccard.estimated_recall([(52, 0, 10)], 8)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 1), (5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- classifiers -----------------------------------------------------------------------------------------------------------

WORDS = {"en": "the of and water house running over yellow where there night morning".split(), "fr": "le de et eau maison courant jaune où nuit matin une être".split(), "ru": "и вода дом бежит жёлтый где ночь утро это был".split()}


def lang_text(lang, n, r):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def test_languages_and_spans(spark):
    r = random.Random(6)
    rows = [(i, lang_text(x, 30, r), x) for i, x in enumerate(r.choice(list(WORDS)) for _ in range(300))]
    rows += [(900, None, "en"), (901, "123 ...", None), (902, "", "fr"), (903, lang_text("fr", 8, r), None)]
    df = spark.createDataFrame([(a, b, c, 0.5) for a, b, c in rows], "doc_id long, text string, lang string, lang_pred double")
    model = langid.train_outside_fold(df)
    out = {x["doc_id"]: x for x in langid.predict(df, model, ["doc_id"]).collect()}
    assert all(out[i]["lang_pred"] == x for i, _, x in rows[:300]) and out[903]["lang_pred"] == "fr"
    assert [out[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and out[900]["score"] == 0
    text = lang_text("en", 12, r) + " " + lang_text("ru", 12, r) + " " + lang_text("en", 12, r)
    assert [s[2] for s in model.spans(text)] == ["en", "ru", "en"]
    a, b, _ = model.spans(text)[1]
    assert text[a:b].split()[0] in WORDS["ru"]
    assert langid.predict(df.limit(0), model, ["doc_id"]).count() == 0
    assert langid.predict(df, None, ["doc_id"]).where("lang_pred = 'und'").count() == len(rows)


def test_viterbi_equals_brute_force():
    from itertools import product

    rng = np.random.default_rng(1)
    score, of = rng.normal(size=(12, 3)).astype(np.float32) * 3, np.array([0, 5, 5, 6, 12])
    got = langid.viterbi(score, of, 1.5)
    for a, b in zip(of, of[1:]):
        if a == b:
            continue
        value = lambda p: sum(score[a + t, k] for t, k in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:]))
        best = max(map(value, product(range(3), repeat=b - a)))
        assert value(got[a:b]) == pytest.approx(best, abs=1e-4)


def test_quality_on_held_out_rows(spark):
    r = random.Random(7)
    good = lambda: ". ".join(lang_text("en", r.randint(5, 12), r).capitalize() for _ in range(8)) + "."
    junk = lambda: r.choice([lambda: "buy now!! " * 40, lambda: " | ".join(lang_text("en", 1, r) for _ in range(60)), lambda: "### $$$ " * 50])()
    rows = [(i, good() if r.random() < 0.8 else junk()) for i in range(900)]
    is_good = {i: not ("!!" in t or "|" in t or "#" in t) for i, t in rows}
    labels = spark.createDataFrame([(i, int(is_good[i]), 0) for i in is_good if i % 2], "doc_id long, quality int, toxic int").union(spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int"))
    df = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    net = quality.train(df, labels)
    out = {x["doc_id"]: x["score"] for x in quality.score(df, net, ["doc_id"]).collect()}
    held = [i for i in is_good if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(out[i] >= 0.7) == is_good[i] for i in held]) > 0.95 and 0.6 < net.prior <= 0.95
    assert 0 <= out[5000] <= 1 and out[5000] == out[5001]
    assert quality.train(df, labels.limit(0)) is None and quality.score(df, None, ["doc_id"]).first()["score"] == 0.5


def test_risk_does_not_fall_below_zero():
    fp, fu = np.array([4.0, 5.0]), np.array([-6.0, -5.0, 4.0])
    _, _, risk = quality.risk_gradient(fp, fu, 0.9)
    assert risk >= 0


def test_segments_of_contractions():
    s = Scan(["it's 'tis ''s"])
    assert [s.joined[a:b] for a, b in zip(*split_words(s))] == ["it", "'s", "'t", "is", "''", "s"]
