"""Repeated ids, ties, other scripts and other hard cases, against brute force where there is one."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from orthant.llm import chat, decontam, langid, linededup, mixing, neardup, pii, quality, queries, substrings, tokens
from tests.llm.test_llm import DOCS, FOLDER, WORDS, docs_of, prose

PAIR = "doc_id long, text string"


def similarity(x: str, y: str) -> float:
    a, b = (decontam.shingle_set(w := decontam.word_list(t), min(5, len(w))) for t in (x, y))
    return len(a & b) / len(a | b)


def test_near_duplicates_of_ids_with_several_texts(spark):
    x, y = prose(1, 60), prose(2, 60)
    docs = spark.createDataFrame([(1, x), (5, y), (5, x), (6, y), (5, x), (None, y), (None, "alone here"), (9, ""), (9, ""), (None, None)], PAIR).withColumn("keep", F.lit("kept"))
    got = Counter((r.doc_id, r.class_id) for r in neardup.near_duplicates(docs).collect())
    assert got == Counter({(1, 1): 1, (5, 1): 1, (5, 5): 1, (6, 5): 1, (None, 5): 1, (None, None): 2, (9, 9): 1})
    left = neardup.drop_near_duplicates(docs)
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(1, x), (5, y), (None, "alone here"), (9, ""), (None, None)]) and left.columns == docs.columns


def test_near_duplicates_recall(spark):
    """Hundreds of pairs between 0.8 and 1, repeats within a text among them: all linked, and no other."""
    rng = random.Random(11)
    texts, want = [], 0
    for g in range(320):
        base = prose(10_000 + g, rng.randint(60, 200)).split()
        if g % 3 == 0:
            base += base[:12] * rng.randint(2, 9)
        other = list(base)
        for _ in range(rng.randint(1, 4)):
            other[rng.randrange(len(other))] = rng.choice(WORDS)
        if g % 3 == 0:
            other += base[:12] * rng.randint(2, 9)
        texts += [" ".join(base), " ".join(other)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    found = 0
    for i in range(0, len(texts), 2):
        near = similarity(texts[i], texts[i + 1]) >= 0.8
        want, found = want + near, found + (near and got[i] == got[i + 1])
        assert near or got[i] != got[i + 1]
    assert want > 200 and found == want


def brute_spans(rows, min_run=substrings.MIN_RUN):
    """(id, text) -> spans, from chunks by dictionaries."""
    documents = sorted(set(rows))
    chunks = {}
    for d in documents:
        data, at = d[1].encode(), 0
        chunks[d] = []
        for e in substrings.chunk_ends([data])[0].tolist():
            chunks[d].append((at, e, xxhash.xxh3_64_intdigest(data[at:e])))
            at = e
    holder = defaultdict(lambda: 2**63)
    for (i, _), cs in chunks.items():
        for c in cs:
            holder[c[2]] = min(holder[c[2]], i)
    out = {}
    for d, cs in chunks.items():
        seen, spans, run = set(), [], None
        for a, b, h in cs:
            later = h in seen or d[0] > holder[h]
            seen.add(h)
            if later and run and run[1] == a:
                run[1] = b
            elif later:
                run = [a, b]
                spans.append(run)
        out[d] = [(a, b - a) for a, b in spans if b - a >= min_run]
    return out


def test_substrings_against_brute_force(spark):
    rng = random.Random(12)
    passages = [prose(700 + i, 40 + 10 * i) for i in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(800 + i, rng.randint(5, 80)) for _ in range(3)]
        for p in rng.sample(passages, rng.randint(0, 2)):
            parts.insert(rng.randrange(4), p[rng.randrange(9) :])
        rows.append((i % 45, " ".join(parts)))
    rows += [rows[3], rows[3], (7, "other text " + prose(990, 90)), (3, passages[5]), (50, "é" * 2000), (51, "ab " * 900), (52, "x")]
    want = brute_spans(rows)
    docs = spark.createDataFrame(rows, PAIR)
    got = substrings.repeated_spans(docs).collect()
    assert Counter((r.doc_id, tuple(map(tuple, r.spans)), r.n_bytes) for r in got) == Counter((d[0], tuple(s), len(d[1].encode())) for d, s in want.items())
    assert sum(map(bool, want.values())) > 15
    for r in substrings.drop_repeats(docs).collect():
        assert any(r.text == cut(t, s) for (i, t), s in want.items() if i == r.doc_id)


def cut(text, spans):
    data = text.encode()
    for a, n in reversed(spans):
        data = data[:a] + data[a + n :]
    return data.decode()


def test_token_ids_of_any_text():
    own = tokens.Encoder(queries.tokenizer_path())
    rng = random.Random(13)
    parts = ["a", "B", "'s", "'RE", ".", "İ", "é", "é", "Σ", "ς", " ", "\n", "\t", "<|", "|>", "endoftext", "ENDOFTEXT", "<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "1", "２", "　", "\x1c", "\x00", "中文", "ไทย", "😀", "‍", "́", "\xa0", "ﬁ", "ǅ", "ẞ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)] + ["中文字" * 20_000, "x1" * 100_000, "w" * 1_000_000]
    assert own.by_word and all(np.frombuffer(own.encode(t), own.dtype).tolist() == own._ids(t) for t in texts)
    assert all(len(w) <= tokens.CACHED_CHARS for w in own.known)


def test_tokens_of_one_id_with_many_rows(spark):
    docs = spark.createDataFrame([(4, prose(i, 20)) for i in range(400)] + [(None, prose(i, 5)) for i in range(300)], PAIR).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shards, folder = tokens.write_tokens(docs, queries.tokenizer_path())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = tokens.read_digests(shards, folder).orderBy("start").collect()
    assert shards.count() == 4 and [r.doc_id for r in rows] == [None] * 300 + [4] * 400
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_items_in_blocks_and_with_equal_texts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 300)
    items = [(i, prose(2000 + i // 3, 6 + i)) if i % 3 else (i, prose(2500, 30)) for i in range(24)]
    texts = [prose(i, 200) + " " + items[i % 24][1] + " " + prose(i + 90, 50) for i in range(0, 60, 2)]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t in enumerate(texts) for i, x in items if decontam.shingle_set(decontam.word_list(x), 5) <= decontam.shingle_set(decontam.word_list(t), 5)}
    got = [(r.doc_id, r.item_id) for r in decontam.contained_items(docs_of(spark, texts), table, threshold=1.0).collect()]
    assert set(got) == want and len(got) == len(want) > 40
    assert decontam.decontaminate(docs_of(spark, [*texts, prose(5, 300)]), table).count() == 1
    few = decontam.Items(["one two", prose(1, 5), prose(2, 14), prose(3, 200)], 0.8)
    assert few.turns.tolist() == [10, 10, 2, 1]


def test_unknown_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train_on(docs)
    known = langid.identify(docs.where("n_chars > 40 and lang is not null"), model).toPandas()
    assert known.rejected.mean() < 0.06 and 0 < model.limit < 1
    foreign = ["これは日本語の文章です。とても良い天気ですね。", "Η γρήγορη αλεπού πηδά πάνω από το σκυλί", "สวัสดีครับ วันนี้อากาศดีมาก", "qx zvk jjwq xxkz vvqj zzkx qqwv kxzj", "여보세요 오늘 날씨가 좋네요"]
    assert model.predict(foreign)[2].all()


def test_surrogates_of_other_kinds(spark):
    texts = [
        "Mrs Ann Smith came. Later Ann Smith left, and Smith's car (SMITHS, Smithson, Annex) stayed.", "Mr Γιώργος Παπαδόπουλος and Γιώργος", "host 2001:db8::ff00:42:8329 or fe80:0:0:0:1:2:3:4, at 12:30:45 or std::vector, 1::2",
        "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432; not DE88 3704 0044 0532 0130 00", "AB12 4539 1488 0343 6467 end", "﷐ Mr Bob Stone ﷐ and Bob, a@b.example", None,
    ]
    got = {r.doc_id: r for r in pii.surrogates(docs_of(spark, texts), "some key").collect()}
    first = re.fullmatch(r"Mrs (\w+) (\w+) came\. Later (\w+) (\w+) left, and (\w+)'s car \(SMITHS, Smithson, Annex\) stayed\.", got[0].text)
    assert first and first[1] == first[3] != "Ann" and first[2] == first[4] == first[5] != "Smith"
    greek = re.fullmatch(r"Mr (\w+) (\w+) and (\w+)", got[1].text)
    assert greek and greek[1] == greek[3] and all(re.fullmatch("[Α-Ωα-ω]+", g) for g in greek.groups()) and "Γιώργος" not in got[1].text
    assert "db8" not in got[2].text and "fe80" not in got[2].text and got[2].text.endswith("at 12:30:45 or std::vector, " + got[2].text.split()[-1]) and got[2].n_ipv6 == 3
    old = re.match(r"IBAN (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d), (GB\d\d[A-Z]{4}\d{14}); not DE88 3704 0044 0532 0130 00", got[3].text)
    for iban in old.groups():
        plain = iban.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert got[3].n_iban == 2 and "3704 0044 0532 0130 00," not in got[3].text and "WEST" not in got[3].text
    assert got[4].n_card == 1 and re.fullmatch(r"AB12 4\d{3} \d{4} \d{4} \d{4} end", got[4].text) and "0343 6467" not in got[4].text
    marked = re.fullmatch("﷐ Mr (\\w+) (\\w+) ﷐ and (\\w+), \\S+@\\S+\\.example", got[5].text)
    assert marked and marked[1] == marked[3] != "Bob" and got[6].text is None
    again = {r.doc_id: r.text for r in pii.surrogates(docs_of(spark, texts), "other key").collect()}
    assert again[0] != got[0].text


def test_chat_ties_and_long_conversations(spark):
    rows = [(1, 0, "user", t, 7) for t in "dbac"] + [(2, i, "user", f"turn {i}", 7) for i in range(3000)] + [(3, i, "user", f"turn {i}", 7) for i in range(2999)]
    names = "conv_id long, turn long, role string, text string, n long"
    table = spark.createDataFrame(rows, names).select("*", *[F.lit(1).alias(c) for c in ("k1", "h1", "p1", "n_turns", "parts", "piece", "chat")])
    got = {r.conv_id: r for r in chat.format_chats(table).collect()}
    assert set(got) == {1, 2} and re.findall(r"user\n(\w)<", got[1].chat) == list("abcd") and got[2].n_turns == 3000


def test_verdict_of_quality_rules(spark):
    """kept and the two shares, from definitions."""
    rng = random.Random(14)
    rules = quality.Rules()
    lines = [prose(i, 8) for i in range(4)]
    texts = [prose(i, 70) + "\n" + "\n".join(rng.choice(lines) + rng.choice(["", "\x0b#", "\x1c"]) for _ in range(rng.randint(0, 12))) for i in range(150)] + [prose(3, 80) + " #" * 30, "ab " * 3 + prose(1, 60)]
    for r, t in zip(quality.quality(docs_of(spark, texts)).orderBy("doc_id").collect(), texts, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        chars, bad, most = sum(map(len, words)), False, 0.0
        for n, limit in rules.coverage:
            grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
            inside = {i + k for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for k in range(n)}
            share = sum(len(words[i]) for i in inside) / chars
            bad, most = bad or share > limit, max(most, share)
        seen, dup = set(), 0
        for line in t.split("\n"):
            inner = re.findall(r"[^\x20\x09-\x0D]+", line)
            dup += sum(map(len, inner)) if line in seen else 0
            seen.add(line)
        mean = chars / len(words)
        bad = bad or dup / chars > rules.max_dup_line_chars or r.n_symbols > rules.max_symbols_per_word * len(words) or not rules.mean_word[0] <= mean <= rules.mean_word[1]
        assert abs(r.dup_line_chars - dup / chars) < 1e-9 and abs(r.dup_ngram_chars - most) < 1e-9 and r.kept == (not r.base_failed and not bad)


def test_many_common_lines_in_one_text(spark):
    lines = [f"common line number {i} of forty characters and more" for i in range(3000)]
    docs = docs_of(spark, ["\n".join(lines)] * 5 + ["\n".join(["own line", *lines, "end"])])
    got = {r.doc_id: r for r in linededup.line_decisions(docs).collect()}
    assert all(got[i].n_dropped == 3000 and got[i].kept_text == "" for i in range(5)) and got[5].n_dropped == 0


def test_pipeline_on_nothing_and_on_hard_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    for name, table in (("none", docs.where("false")), ("hard", spark.createDataFrame([(None, None, None, None), (1, "", "en", None), (2, prose(1, 100), None, "a"), (2, prose(1, 100), None, "a"), (2, prose(3, 90), "en", "b"), (None, prose(5, 30_000), "en", "a")], DOCS).withColumn("row", F.lit(1)))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    hard = corpus_pipeline.run(spark, f"{tmp_path}/hard").collect()
    assert {r.doc_id for r in hard} == {None, 2} and sum(r.n_tokens for r in hard) > 30_000
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.read.parquet(f"{tmp_path}/hard/documents.parquet"), f"{tmp_path}/hard")
        assert out.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "row"]


def test_mix_reaches_the_targets(spark):
    rng = random.Random(15)
    rows = [(i, prose(i, rng.choice([5, 40, 3000])), "en", "abcdef"[min(i % 9, 5)]) for i in range(90)] + [(5, prose(1, 40), "en", "a"), (None, "", "en", None), (None, None, "en", "z")]
    docs = spark.createDataFrame(rows, DOCS)
    plan = mixing.mixture(docs).toPandas()
    got, want = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        got[r.source] += len((r.text or "").split())
    source = {r[0]: r[3] for r in rows}
    for r in plan.itertuples():
        want[source[None if np.isnan(r.doc_id) else int(r.doc_id)]] += r.taken
    assert +got == +want
