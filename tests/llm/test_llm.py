"""The corpus operators against brute force, SQL and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orthant.llm import chat, decontam, langid, linededup, mixing, neardup, pii, quality, queries, storage, substrings, textscan, tokens
from tests.compare import differs, duck

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
WORDS = [f"w{i}x{'abcdefg'[i % 7]}" for i in range(400)]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = prose(99, 30_000)
EDGE = [
    (None, "no id here but some words to read", "en", "a"), (1, None, None, None), (2, "", "en", None), (3, "   \n\t\n ", "en", "a"), (4, "one two", "en", "a"), (5, prose(1, 90), "en", "a"), (5, prose(1, 90), "en", "a"),
    (6, prose(1, 90), "fr", "b"), (7, prose(1, 89) + " changed", "fr", "b"), (8, LONG, "fr", "ü"), (9, "日本語 テスト é́ 😀 123", "de", "c"), (10, prose(2, 60) + "\n" + prose(1, 90), "de", "c"), (11, "$$$ ### 42", None, "c"),
]


@pytest.fixture(scope="module")
def edge(spark):
    """Rows with nulls, repeats, ties, a very long text, and columns whose names operators use themselves."""
    extra = ["kept", "size", "label", "row", "bucket", "n_words", "spans", "drop", "order", "start", "taken", "times", "id", "hash"]
    return spark.createDataFrame(EDGE, DOCS).select("*", *[F.lit(7).alias(c) for c in extra]).repartition(3)


@pytest.fixture(scope="module")
def none(edge):
    return edge.where("false")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    assert differs(queries.queries()[name](spark, FOLDER), duck(FOLDER), queries.oracle_sql()[name]) == ""


def test_edges_of_all(spark, edge, none):
    items = spark.createDataFrame([(1, prose(2, 30)), (2, None), (3, ""), (4, "one two"), (None, "日本語 テスト")], "item_id long, text string")
    nothing = items.where("false")
    model = langid.fit([r[1] for r in EDGE if r[1] and r[2]], [r[2] for r in EDGE if r[1] and r[2]])
    path = queries.tokenizer_path()
    run = {
        "quality": lambda d: quality.quality(d), "langid": lambda d: langid.identify(d, model), "lines": lambda d: linededup.line_decisions(d), "tokens": lambda d: tokens.token_digests(d, path), "mix": lambda d: mixing.mixture(d), "pii": lambda d: pii.surrogates(d, "k"),
    }
    for name, f in run.items():
        assert f(edge).count() == len(EDGE), name
        assert f(none).count() == 0, name
    assert neardup.near_duplicates(edge).count() == substrings.repeated_spans(edge).where("doc_id is not null").count() + 1 == 12
    assert neardup.near_duplicates(none).count() == substrings.repeated_spans(none).count() == 0
    assert decontam.contained_items(edge, nothing).count() == decontam.contained_items(none, items).count() == 0
    hits = {(r.doc_id, r.item_id) for r in decontam.contained_items(edge, items).collect()}
    assert hits == {(10, 1), (4, 4), (9, None)}
    assert Counter(r.doc_id for r in decontam.decontaminate(edge, items).collect()) == Counter(r[0] for r in EDGE if r[0] not in (4, 9, 10))
    assert decontam.decontaminate(edge.withColumn("doc_id", F.lit(None).cast("long")), items).count() == len(EDGE) - 3
    for f in (quality.keep_good, neardup.drop_near_duplicates, mixing.mix, linededup.drop_common_lines, substrings.drop_repeats, lambda d: decontam.decontaminate(d, items)):
        assert f(edge).columns == edge.columns and f(none).columns == edge.columns and f(none).count() == 0
        assert f(edge).schema == edge.schema


def test_quality_against_brute_force(spark):
    rng = random.Random(3)
    texts = [("\n" if rng.random() < 0.5 else " ").join(rng.choice(["a b", "c", "a b c", "#x", "é|", " ", "d\te"]) for _ in range(rng.randint(0, 70))) for _ in range(300)] + [LONG, prose(5, 200), "spam spam eggs " * 60, None]
    for r, text in zip(quality.quality(docs_of(spark, texts).coalesce(1)).orderBy("doc_id").collect(), texts, strict=True):
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        n = len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside))
        assert r.base_failed == (n < 50 or 100 * len(inside) > 50 * n) and not (r.base_failed and r.kept)
        for size, _ in quality.Rules().coverage[:1]:
            grams = Counter(tuple(words[i : i + size]) for i in range(n - size + 1))
            inside = {i + k for i in range(n - size + 1) if grams[tuple(words[i : i + size])] > 1 for k in range(size)}
            assert r.dup_ngram_chars >= sum(len(words[i]) for i in inside) / max(1, r.word_chars) - 1e-9
    kept = {r.doc_id for r in quality.quality(docs_of(spark, texts)).where("kept").collect()}
    assert {300, 301} <= kept and 302 not in kept


def test_language_held_out_accuracy(spark):
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    model = langid.fit(["hello there"] * 3, ["en"] * 3)
    assert model.predict([None, "", "123 !"])[0] == ["und"] * 3 and model.predict(["x"])[0] == ["en"] and langid.fit([], []).predict(["x"])[0] == ["und"]


def test_decontamination_against_brute_force(spark):
    items = [(i, prose(1000 + i, n)) for i, n in enumerate([5, 6, 9, 16, 30, 59, 3])]
    rng = random.Random(4)
    texts = []
    for i in range(40):
        words = prose(i, rng.choice([20, 300, 5000])).split()
        for _, t in rng.sample(items, 2):
            part = t.split()
            if rng.random() < 0.4 and len(part) > 20:
                part[rng.randrange(len(part))] = "other"
            at = rng.randrange(len(words))
            words[at:at] = part
        texts.append(" ".join(words).upper() if i % 3 else ", ".join(words))
    want = set()
    for d, t in enumerate(texts):
        w = decontam.word_list(t)
        for i, x in items:
            v = decontam.word_list(x)
            n = min(5, len(v))
            s = decontam.shingle_set(v, n)
            if len(s & decontam.shingle_set(w, n)) >= 0.8 * len(s) - 1e-9:
                want.add((d, i))
    got = decontam.contained_items(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 40


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for g in range(12):
        base = prose(100 + g, 150).split()
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
    shared = prose(7, 80)
    texts += [shared + " " + prose(500 + i, 60) for i in range(30)] + [texts[0]] * 5
    sets = [decontam.shingle_set(decontam.word_list(t), 5) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


def test_tiles_lose_no_link(spark, monkeypatch):
    """Buckets larger than a tile are compared across tiles."""
    base = prose(8, 150).split()
    texts = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(5, 145, 5)]
    monkeypatch.setattr(neardup, "TILE", 4)
    got = {r.class_id for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {0}


def test_a_collision_of_bytes_in_an_earlier_band_loses_no_link(spark):
    """Members 2 and 3 share band 1; in band 0 only the bytes of their signatures agree."""
    sig, same = bytes(neardup.REGISTERS), np.arange(50, dtype=np.uint32).tobytes()
    other = np.arange(1000, 1050, dtype=np.uint32).tobytes()
    sketch = spark.createDataFrame([(i, [i, 7, *range(100 * i, 100 * i + neardup.BANDS - 2)], sig) for i in (1, 2, 3)], "rep long, bands array<long>, sig binary")
    sets = spark.createDataFrame([(1, other), (2, same), (3, same)], "rep long, shingles binary")
    members = spark.createDataFrame([(7, 1, i, 1) for i in (1, 2, 3)], "bucket long, band int, rep long, centre long")
    none = spark.createDataFrame([], "node long, label long")
    assert [tuple(r) for r in neardup.rest_of_buckets(members, none, sketch, sets).collect()] == [(3, 2)]


def test_repeats_within_a_text_lose_no_link(spark):
    """Sets of a similarity of 0.8 or more are linked however often a text repeats its shingles."""
    base, line = prose(70, 300).split(), prose(71, 12)
    texts = [" ".join([*base, *[line] * 3]), " ".join([*base[:150], "changed", *base[151:], *[line] * 40])]
    sets = [decontam.shingle_set(decontam.word_list(t), 5) for t in texts]
    assert all(len(sets[0] & s) >= 0.9 * len(sets[0] | s) for s in sets)
    assert {r.class_id for r in neardup.near_duplicates(docs_of(spark, texts)).collect()} == {0}


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(6)
    x, y = rng.integers(1, 5, 300).astype(float), rng.integers(1, 5, 300).astype(float)
    x[:60] = 0
    h = textscan.mix(np.arange(300, dtype=np.uint64))
    sig = [neardup.probminhash(h[v > 0], v[v > 0], np.zeros((v > 0).sum(), int), 1, 4000)[0] for v in (x, y)]
    want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(300) if x[i] and y[i])
    assert abs((sig[0] == sig[1]).mean() - want) < 0.035


def test_tokens_round_trip(spark, tmp_path):
    path = queries.tokenizer_path()
    own = tokens.Encoder(path)
    rng = random.Random(7)
    texts = ["".join(rng.choice("aB'sStT.,İé́Σσ \n\t<|>1　\x1c") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["<|endoftext|> x", LONG[:5000], "", None]
    assert all(np.frombuffer(own.encode(t), own.dtype).tolist() == own._ids(t) for t in texts if t)
    shards, folder = tokens.write_tokens(docs_of(spark, texts).repartition(3), path, length=16, folder=str(tmp_path / "out"))
    want, start = {}, 0
    for i, t in enumerate(texts):
        ids = [*own._ids(t or ""), 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_digests(shards, folder).collect()} == want
    shard = tokens.Shard(f"{folder}/tokens", shards.orderBy("shard").first().shard)
    ids, mask = shard.sequence(0)
    flat = [x for t in texts for x in [*own._ids(t or ""), 2]]
    assert ids.tolist() == flat[:16] and mask.to_pylist() == [True] * 16


def test_substrings(spark):
    passage = prose(909, 55)
    texts = [prose(i, 120) + f" {i} " + (passage if i in (3, 7, 11) else "") + " " + prose(i + 50, 100) for i in range(20)] + [""]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in substrings.repeated_spans(docs).collect()}
    assert {i for i, r in got.items() if r.n_dropped} == {7, 11} and all(got[i].kept_in == [3] for i in (7, 11))
    assert {i for i, r in got.items() if r.n_shared >= 100} == {3, 7, 11} and all(r.n_bytes == len(texts[i].encode()) for i, r in got.items())
    left = {r.doc_id: r.text for r in substrings.drop_repeats(docs).collect()}
    assert left[3] == texts[3] and len(left[7]) < len(texts[7]) - 100 and left[7].startswith(prose(7, 100))
    data = "héllo wörld ".encode() * 200 + random.Random(1).randbytes(0)
    ends = substrings.chunk_ends([data])[0]
    assert ends[-1] == len(data) and all(data[:e].decode() is not None for e in ends)
    gear = [int(g) for g in substrings.GEAR]
    h, slow = 0, []
    for b in data[:300]:
        h = ((h << 1) + gear[b]) & 0xFFFF
        slow.append(h)
    assert substrings.gear_hashes(np.frombuffer(data[:300], np.uint8)).tolist() == slow


def test_surrogates(spark):
    texts = [
        "write to Ann.Lee@mail.example.com or ANN.LEE@MAIL.EXAMPLE.COM, or bob@mail.example.com", "call +1 (415) 555-0132 or +14155550132; card 4539 1488 0343 6467, id 4539148803436468", "host 10.2.3.4, version 1.2.3.4.5", 'token = "dfd1944d2e84f15e89902e34b677eb5a8a7d42ab"',
        "Mrs. Ann Smith met Mr Smith and Frau Müller; г-н Иванов came", "nothing here: 12345 words, a@b", "",
    ]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in pii.surrogates(docs, "k").collect()}
    assert [got[i].text for i in (5, 6)] == texts[5:] and "version 1.2.3.4.5" in got[2].text and "id 4539148803436468" in got[1].text
    for i, secret in ((0, "nn.lee@"), (0, "bob@"), (1, "555-0132"), (1, "0343 6467"), (2, "10.2.3.4,"), (3, "dfd1944d"), (4, "Ann Smith"), (4, "Müller"), (4, "Иванов")):
        assert secret.lower() not in got[i].text.lower()
    mails = re.findall(r"\S+@\S+?(?=[,\s]|$)", got[0].text)
    assert mails[0].lower() == mails[1].lower() != mails[2] and mails[1].isupper() and mails[0].split("@")[1] == mails[2].split("@")[1]
    phones = re.search(r"call (.*) or (.*); card (\d{4} \d{4} \d{4} \d{4}),", got[1].text)
    assert re.sub(r"\D", "", phones[1]) == re.sub(r"\D", "", phones[2]) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[1]) and phones[3][0] == "4"
    digits = [int(c) for c in phones[3].replace(" ", "")]
    assert sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    names = re.fullmatch(r"Mrs\. (\w+na) (\w+) met Mr (\w+) and Frau (\w+); г-н (\w+) came", got[4].text)
    assert names and names[2] == names[3] != names[4] and re.fullmatch("[А-я]+", names[5])
    assert sorted((r.doc_id, r.text) for r in pii.surrogates(docs.repartition(5), "k").collect()) == sorted((i, r.text) for i, r in got.items())


def test_cards_beside_other_digits(spark):
    cards = ["4539 1488 0343 6467", "4539148803436467", "3530 1113 3330 0000", "3056 930902 5904", "3782 822463 10005", "4111-1111-1111-1111"]
    frames = ["{}", "{} 12/27", "{} 124", "55 {} 12", "2026 {}", "on 2026-11-26 {} 4111 1111 1111 1111 99", "{} 555-123-4567", "{} 12.34.56.78 é", "{} " + "7 " * 3000]
    texts = [f.format(c) for c in cards for f in frames]
    got = {r.doc_id: r for r in pii.surrogates(docs_of(spark, texts), "k").collect()}
    for i, t in enumerate(texts):
        card, f = cards[i // len(frames)], i % len(frames)
        assert card not in got[i].text and got[i].n_card == (2 if f == 5 else 1), (t, got[i])
        assert re.sub(r"\d", "0", got[i].text) == re.sub(r"\d", "0", t) or f == 7, (t[:60], got[i])
        digits = [int(c) for c in re.sub(r"\D", "", t)]
        by_chance = sum(sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits))) % 10 == 0
        assert f != 2 or by_chance or got[i].text.endswith(" 124"), (t, got[i])
        assert got[i].n_phone == (f == 6) and got[i].n_ip == (f == 7), (t, got[i])


def test_surrogates_collide_never(spark, monkeypatch):
    """With few possible draws, distinct entities still get distinct surrogates, none of them real."""
    ents = spark.createDataFrame([("ip", f"1.1.1.{i}") for i in range(200)], "kind string, canon string")
    few = lambda key, attempt: F.concat(F.lit("1.1.1."), F.pmod(F.xxhash64("canon", F.lit(attempt)), F.lit(300 + 300 * attempt)).cast("string"))
    monkeypatch.setattr(pii, "candidate", few)
    rows = pii.entity_map(ents, storage.shared_dir(spark), "k").collect()
    real = {f"1.1.1.{i}" for i in range(200)}
    assert len({r.canon for r in rows}) == 200 == len({r.surrogate for r in rows}) and not real & {r.surrogate for r in rows}


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", "hi"), (4, 1, "assistant", "other"), (5, 0, None, None), (6, 1, "assistant", "<|im_end|>"), (6, 0, "user", "a"), (None, 0, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(table).collect()}
    assert set(got) == {2, 4, 5, 6} and got[2].n_same == 2 and got[6].chat == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\n<| im_end |><|im_end|>\n"
    assert chat.format_chats(table.where("false")).count() == 0


def test_mix(spark):
    rows = [(i, prose(i, 40 + i % 30), "en", "abcdef"[min(i % 9, 5)]) for i in range(600)]
    got = mixing.mixture(spark.createDataFrame(rows, DOCS)).toPandas()
    assert (got.taken <= 3 * got["size"]).all() and abs(got.taken.sum() / got["size"].sum() - 1) < 0.01
    source = {r[0]: r[3] for r in rows}
    by = got.assign(source=got.doc_id.map(source)).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert ((by.taken - by.target).abs() <= 0.03 * by.target).all() and (by.target <= 3 * by["size"] + 1e-6).all()
    again = mixing.mixture(spark.createDataFrame(rows, DOCS).repartition(7)).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, again.values.tolist()))
    one = mixing.mixture(spark.createDataFrame([(1, "a b c", "en", "x")], DOCS)).first()
    assert (one.target, one.taken) == (3.0, 3) or one.taken <= 9


def test_line_dedup_keeps_the_last(spark):
    line = "This work is licensed under some terms of ours, version 3."
    texts = [f"{i} head\n  {line.upper() if i % 2 else line}\t\ntail {i}\n{line}" for i in range(6)]
    got = {r.doc_id: r.text for r in linededup.drop_common_lines(docs_of(spark, texts)).collect()}
    assert got[5] == texts[5] and all(got[i] == f"{i} head\ntail {i}" for i in range(5))
    digest = {r.doc_id: hashlib.sha256(r.kept_text.encode()).hexdigest() for r in linededup.line_decisions(docs_of(spark, texts)).collect()}
    assert digest[0] == hashlib.sha256(b"0 head\ntail 0").hexdigest()


def test_pipeline_stage_by_stage(spark):
    """Each stage takes effect on its own input, and run() gives what the stages give one by one."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    step = dict(corpus_pipeline.STAGES)
    good = step["quality_rules"](spark, docs, FOLDER)
    verdict = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == verdict and good.columns == docs.columns
    once = step["near_dedup"](spark, good, FOLDER)
    classes = defaultdict(list)
    for r in neardup.near_duplicates(good).collect():
        classes[r.class_id].append(r.doc_id)
    assert {r.doc_id for r in once.collect()} == {min(v) for v in classes.values()}
    clean = step["decontamination"](spark, once, FOLDER)
    leaks = {r.doc_id for r in decontam.contained_items(once, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in once.collect()} - leaks
    mixed = step["source_mix"](spark, clean, FOLDER)
    plan = mixing.mixture(clean).join(clean.select("doc_id", "source"), "doc_id").collect()
    emitted, takes = Counter(), Counter()
    source = {r.doc_id: r.source for r in plan}
    for r in mixed.collect():
        emitted[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    for r in plan:
        takes[r.source] += r.taken
    assert +emitted == +takes and mixed.columns == docs.columns and set(source) >= {r.doc_id for r in mixed.collect()}
    targets = {r.source: r.target for r in plan}
    assert all(abs(emitted[s] - t) <= max(0.03 * t, 2 * mixing.BLOCK_WORDS) for s, t in targets.items())
    rows = sorted(((r.doc_id, r.text) for r in mixed.collect()), key=lambda r: r[0])
    got = sorted(corpus_pipeline.run(spark, FOLDER).collect(), key=lambda r: r.start)
    encode = tokens.Encoder(queries.tokenizer_path())
    crcs, start = Counter(), 0
    for doc_id, t in rows:
        crcs[doc_id, zlib.crc32(np.array([*encode._ids(t), 2], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == crcs and [r.doc_id for r in got] == [r[0] for r in rows]
    for r in got:
        assert r.start == start
        start += r.n_tokens
