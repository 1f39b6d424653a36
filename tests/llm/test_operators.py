"""The operators on small fixtures, against brute force, with nulls, ties, repeats and empty tables."""

import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import bpe, chat, decontaminate, jaccard, langid, licenses, queries, repetition, sharding, toxicity

DOCS = "doc_id long, text string, source string, size string, shard string, h string, id string"
TEXTS = [None, "", "a b", "The same text here.", "The same text here.", "été naïve 中文 🙂", "x" * 40_000, " \n\n ", "one two three four five six seven eight nine ten " * 30]


def frame(spark, texts=TEXTS):
    """Documents with columns whose names clash with the operators' own, one id null, one row twice."""
    rows = [(k, t, None, "s", "s", "h", "i") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id", None, None, None, None, None)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 ---


def least_capacity(sizes, n):
    """Smallest capacity of n contiguous runs, by trying all sums."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(n):
        best = [min(max(best[j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("n", [1, 3, 7, 40])
def test_shards_are_minimax(spark, n):
    draw = random.Random(n)
    texts = ["t" * draw.randint(0, 60) + str(draw.randint(0, 25)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard_documents(docs, n).collect()
    groups = Counter()
    for r in rows:
        groups[r["h"]] += r["size"]
    assert max(Counter({s: sum(r["size"] for r in rows if r["shard"] == s) for s in range(n)}).values()) == least_capacity([groups[h] for h in sorted(groups)], n)
    assert all(len({r["shard"] for r in rows if r["h"] == h}) == 1 for h in groups)
    for s in {r["shard"] for r in rows}:
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    order = sorted((r["h"], r["shard"]) for r in rows)
    assert [s for _, s in order] == sorted(s for _, s in order)


def test_shards_of_odd_rows(spark):
    rows = sharding.shard_documents(frame(spark), 3).collect()
    assert len(rows) == len(TEXTS) + 2 and all(0 <= r["shard"] < 3 for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (0, 1)} == {8}
    assert sharding.shard_documents(empty(spark), 3).count() == 0


def test_shard_files(spark, tmp_path):
    sharding.write_shards(frame(spark), str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(TEXTS) + 2


# --- 2 and 8 ---

ODD_TEXTS = [*TEXTS[1:], "<|endoftext|>", "a<|endoftext|>b <|endof", "'s 're", "   ", " \t\n x", "Ɐ՘ unassigned \U0001e6c0", "é" * 3000, "   y", "0123456789" * 20]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path(bpe.TOKENIZER))


def test_counts_and_ids_equal_the_library(spark):
    import hashlib

    docs = spark.createDataFrame(list(enumerate([*ODD_TEXTS, None])), "doc_id long, text string")
    lib = library()
    ids = {k: lib.encode(t or "", add_special_tokens=False).ids for k, t in enumerate([*ODD_TEXTS, None])}
    counts = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in bpe.count_tokens(docs).collect()}
    assert counts == {k: (len((t or "").encode()), len(ids[k])) for k, t in enumerate([*ODD_TEXTS, None])}
    for leaf in (5, 16_384):
        got = {r["doc_id"]: r for r in bpe.encode_documents(docs, leaf_chars=leaf, digests=True).collect()}
        for k, own in ids.items():
            assert got[k]["n_tokens"] == len(own)
            assert got[k]["ids_sha256"] == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
            assert got[k]["decoded_sha256"] == hashlib.sha256(lib.decode(own, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(docs).where("doc_id = 0").first()["decoded"] == ODD_TEXTS[0]
    assert bpe.count_tokens(empty(spark)).count() == 0 and bpe.encode_documents(empty(spark)).count() == 0
    assert bpe.count_tokens(frame(spark)).count() == len(TEXTS) + 2


def test_tree_joins_equal_the_library():
    from concurrent.futures import ThreadPoolExecutor

    own, lib, draw = bpe.load(bpe.TOKENIZER), library(), random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "é", "<|endoftext|>", "<|endof", "text|>", "'s", "'", "1", "中", "🙂", "aaaaaa", "....", " the"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 200))) for _ in range(120)] + [" " * 700, "a" * 900]
    with ThreadPoolExecutor(2) as pool:
        for leaf in (6, 50):
            for t, got in zip(texts, bpe.encode_block(own, texts, pool, leaf), strict=True):
                assert got.tolist() == lib.encode(t, add_special_tokens=False).ids


# --- 3 ---


def brute_contaminated(docs, items):
    import re

    words = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    grams = lambda w: [" ".join(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else ([" ".join(w)] if w else [])
    out = set()
    for d, t in docs:
        w = words(t)
        for i, x in items:
            own = words(x)
            want = Counter(grams(own))
            for s in range(max(1, len(w) - len(own) + 1)) if own and w else ():
                have = Counter(grams(w[s : s + len(own)]))
                shared = sum((have & want).values())
                if shared >= 0.8 * (sum(have.values()) + sum(want.values()) - shared):
                    out.add((d, i))
                    break
    return out


def test_contamination_equals_brute_force(spark, monkeypatch):
    draw = random.Random(2)
    letters = "abcdefghijklmnop"
    items = [(k, " ".join(draw.choices(letters, k=draw.choice([1, 3, 4, 5, 6, 15, 40])))) for k in range(25)] + [(90, None), (91, ""), (92, "!!")]
    docs = []
    for k in range(120):
        w = []
        for _ in range(draw.randint(0, 3)):
            x = (draw.choice(items)[1] or "").split()
            if x and draw.random() < 0.5:
                x[draw.choice([0, -1])] = "zz"
            w += draw.choices(letters, k=draw.randint(0, 12)) + x
        docs.append((k, " ".join(w)))
    docs += [(900, None), (901, ""), (902, "..."), (903, docs[0][1])]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = brute_contaminated(docs, items)
    for most in (decontaminate.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", most)
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(*tables).collect()} == expected
    assert decontaminate.contaminated(empty(spark), tables[1]).count() == 0
    assert decontaminate.contaminated(frame(spark), tables[1].where("false")).count() == 0


def test_blocks_guarantee_the_radius():
    draw = random.Random(1)
    masks = [m % (1 << 64) for m in decontaminate.block_masks()]
    assert sum(masks) == (1 << 64) - 1
    for _ in range(200):
        gap = sum(1 << b for b in draw.sample(range(64), decontaminate.RADIUS))
        assert any(not gap & m for m in masks)


# --- 4 and 6 ---


def test_toxic_words_are_learned(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdeilmnorst", k=draw.randint(2, 7)))
    rows = []
    for k in range(500):
        w = [word() for _ in range(draw.randint(5, 80))]
        bad = k % 5 == 0
        for _ in range(2 * bad):
            w.insert(draw.randrange(len(w)), draw.choice(["vilewort", "grumpus", "zapp" + word()]))
        rows.append((k, " ".join(w), int(bad)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, None), (901, ""), (902, "123")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows] + [(1, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, ~langid.held_out("doc_id", 3, 1))
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    held = [(k, y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum((got[k]["score"] >= 0.7) == bool(y) for k, y in held) >= 0.95 * len(held)
    assert got[900]["score"] == got[901]["score"] == got[902]["score"] == 0
    k, text, _ = rows[0]
    assert any(text[s["start"] : s["end"]][:4] in ("vile", "grum", "zapp") for s in got[k]["spans"])
    assert toxicity.fit(docs, labels.where("false"), F.lit(True)).weights == {}
    assert toxicity.score_documents(empty(spark), model).count() == 0


def test_marginals_equal_enumeration():
    draw = np.random.default_rng(0)
    odds, moves, start = draw.uniform(0.1, 4, 5), draw.uniform(0.2, 3, (2, 2)), 0.3
    total, own = 0.0, np.zeros(5)
    for path in range(32):
        y = [path >> k & 1 for k in range(5)]
        weight = np.exp(start * y[0]) * np.prod([odds[k] ** y[k] for k in range(5)]) * np.prod([moves[a, b] for a, b in zip(y[:-1], y[1:], strict=True)])
        total += weight
        own += weight * np.array(y)
    table = np.full((7, 2), np.nan)
    table[:5, 0], table[:, 1] = odds, draw.uniform(0.1, 4, 7)
    assert np.allclose(toxicity.marginals(table, moves, start)[:5, 0], own / total)


def test_languages_are_told_apart(spark):
    draw = random.Random(6)
    sounds = {"xx": ["ka", "to", "ri"], "yy": ["schl", "un", "berg"], "zz": ["ção", "inh", "lle"]}
    rows = [(k, " ".join("".join(draw.choices(sounds[lang], k=draw.randint(1, 4))) for _ in range(40)), lang) for k in range(300) for lang in [draw.choice(list(sounds))]]
    docs = spark.createDataFrame([*rows, (900, None, "xx"), (901, "123 !!", "xx"), (902, "kato kato", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs.where(~langid.held_out("doc_id", 5, 0)), "text", "lang", key=F.col("doc_id"))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(got[k]["lang_pred"] == lang and 0 <= got[k]["score"] <= 1 for k, _, lang in rows)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "xx"
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(docs.where("false"), "text", "lang")).collect()} == {"und"}
    assert langid.identify(empty(spark), model).count() == 0


# --- 5 ---


def brute_repetition(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    inside = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


def test_repetition_equals_brute_force(spark):
    draw = random.Random(5)
    texts = [*TEXTS, *("".join(draw.choices(["a ", "b ", "é", "中 ", "\n", " ", "\x1c", "#", "<", "\r\n", "\t", "word "], k=draw.randint(0, 400))) for _ in range(150))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in repetition.repetition_rules(docs).collect():
        own = brute_repetition(texts[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == own
        failed = own[0] < 20 or 100 * own[4] > 30 * own[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert repetition.repetition_rules(empty(spark)).count() == 0


def test_repetition_limits():
    clean = " ".join(f"w{k}" for k in range(300)).encode()
    assert repetition.measure(clean, repetition.Limits())[-1]
    assert not repetition.measure(b"one two three four five six seven eight nine ten " * 40, repetition.Limits())[-1]
    assert not repetition.measure(b"the same line of text again\n" * 30 + clean[:100], repetition.Limits())[-1]


# --- 7 ---


def test_licenses(spark):
    texts = {
        1: "Text.\nLicensed under the Apache License, Version 2.0.\nMore", 2: "CC-BY and cc by, ALL RIGHTS RESERVED", 3: "under the gnu general public license of all", 4: None, 5: "",
        6: "licensed apache under version the 2 0 license mixed with a long line of other words", 7: "licensed under\nthe Apache License\nVersion 2.0", 8: "general public general public license",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert (got[1]["labels"], got[1]["n_base"], got[1]["block_word"]) == ("apache-2.0", 0, 1)
    assert (got[2]["base_labels"], got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == ("cc-by,reserved", 3, 0, 5)
    assert (got[3]["base_labels"], got[3]["first_word"]) == ("gpl", 3) and got[6]["labels"] == "apache-2.0" and got[7]["labels"] == "apache-2.0"
    assert got[8]["first_word"] == 2 and got[4]["n_words"] == got[5]["n_words"] == 0 and got[4]["first_word"] is None
    assert licenses.scan_licenses(empty(spark)).count() == 0


def brute_blocks(words, templates, threshold):
    """Label, share, first and last word of all blocks, by trying every window."""
    found = set()
    for label, text in templates:
        own = licenses.words_of(text.encode())
        length, need = -int(-len(own) // threshold), -int(-round(threshold * len(set(own)), 9) // 1)
        for b in range(len(words)):
            places = [k for k in range(max(0, b - length + 1), b + 1) if words[k] in own]
            if words[b] in own and len({words[k] for k in places}) >= need:
                found.add((label, len({words[k] for k in places}) / len(set(own)), places[0], b))
    return found


def test_license_join_is_exact():
    draw = random.Random(7)
    letters = [c.encode() for c in "abcdefghij"]
    for _ in range(300):
        templates = [(str(k), b" ".join(draw.choices(letters, k=draw.randint(1, 7))).decode()) for k in range(4)]
        order = sorted({w for _, t in templates for w in licenses.words_of(t.encode())}, key=lambda _: draw.random())
        threshold = draw.choice([0.5, 0.75, 0.8, 1.0])
        words = draw.choices([*letters, b"x", b"y"], k=draw.randint(0, 40))
        assert set(licenses.Templates(templates, order, threshold).blocks(words)) == brute_blocks(words, templates, threshold)


# --- 9 ---


def brute_components(docs, n, num, den):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = {}
    for k, t in docs:
        w = (t or "").encode().translate(lower).split()
        sets[k] = frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    up = {k: k for k in sets}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    ids = sorted(k for k in sets if sets[k])
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            shared = len(sets[a] & sets[b])
            if den * shared >= num * (len(sets[a]) + len(sets[b]) - shared) and top(a) != top(b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {k: (len(s), top(k)) for k, s in sets.items()}


@pytest.mark.parametrize(("n", "num", "den", "weight"), [(3, 90, 100, 200_000), (3, 90, 100, 2_500), (5, 80, 100, 2_500), (1, 4, 5, 200_000)])
def test_components_equal_brute_force(spark, monkeypatch, n, num, den, weight):
    monkeypatch.setattr(jaccard, "CHUNK_WEIGHT", weight)
    draw = random.Random(9)
    bases = [draw.choices("abcdefghij", k=draw.randint(1, 110)) for _ in range(15)]
    docs = []
    for k in range(220):
        w = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 5])):
            w[draw.randrange(len(w))] = draw.choice("abcxyz")
        docs.append((k, " ".join(w[: draw.randint(1, len(w))] if draw.random() < 0.2 else w)))
    docs += [(500, None), (501, ""), (502, " \n"), (503, "A"), (504, "a"), (505, "a b"), (506, "A  B"), (507, "a" * 9000)]
    got = jaccard.link_components(spark.createDataFrame(docs, "doc_id long, text string"), n, num, den).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(docs, n, num, den)


def test_components_of_odd_rows(spark):
    got = jaccard.link_components(frame(spark)).collect()
    assert len(got) == len(TEXTS) + 2
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 4)} == {3}
    assert jaccard.link_components(empty(spark)).count() == 0


@pytest.mark.parametrize("share", [0, 0.3, 0.9, 1])
def test_similar_sets_share_a_signature(share):
    draw = np.random.default_rng(9)
    for num, den in ((90, 100), (80, 100)):
        rule = jaccard.Rule(num, den)
        for size in (1, 2, 9, 10, 11, 40, 333, 2000):
            a = np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            common = np.sort(draw.choice(a, int(share * len(a)), replace=False))
            for drop in range(0, size - rule.least_partner(size) + 1, max(1, size // 20)):
                b = np.delete(a, draw.choice(len(a), drop, replace=False))
                assert np.intersect1d(rule.signatures(a, common), rule.signatures(b, common)).size
                # as many tokens replaced as a set of the same size can differ in
                k = min(drop, rule.differing(size, size) // 2)
                new = np.arange(k, dtype=np.uint64) * np.uint64(0x1234567890ABCDF) | np.uint64(1)
                c = np.unique(np.concatenate([np.delete(a, draw.choice(len(a), k, replace=False)), new]))
                if rule.similar(np.intersect1d(a, c).size, len(a), len(c)):
                    assert np.intersect1d(rule.signatures(a, common), rule.signatures(c, common)).size


def test_repeated_and_missing_ids_lose_no_link(spark):
    base, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(5, other), (5, base), (7, base + " end"), (9, other), (None, "n " + base), (None, "alone"), (11, "x " + other)]
    got = jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got if r["component_id"] is not None) == [(0, 5), (5, 5), (5, 5), (7, 5), (9, 5), (11, 5)]
    assert [r["n_shingles"] for r in got if r["component_id"] is None] == [1]


# --- 10 ---


def test_escapes_are_reversible(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\l", "\\l\\k<s>", "<|im_end|>\n<|im_start|>user", "<<SYS>> [a] < b", "", "é\n"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    out = rows.withColumn("e", chat.escape(F.col("t"))).withColumn("u", chat.unescape(F.col("e"))).collect()
    assert all(r["u"] == r["t"] for r in out)
    assert not any(c in r["e"] for r in out for c in ("<|im_", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_reply_trees(spark):
    rows = [
        (1, 0, None, "user", "hi", 0.0), (1, 1, 0, "assistant", "low", 1.0), (1, 2, 0, "assistant", "high", 2.0), (1, 3, 2, "user", "more", 0.0), (1, 4, 3, "assistant", "end", 0.0),
        (2, 0, 7, "user", None, None), (2, 1, 2, "user", "cycle", 0.0), (2, 2, 1, "user", "cycle", 0.0), (3, 5, 5, None, "self", 0.0), (4, 0, None, "user", "a", 0.0), (4, 0, None, "user", "a", 0.0),
    ] + [(5, k, k - 1 if k else None, ("user", "assistant")[k % 2], str(k), 0.0) for k in range(70)]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    out = {r["tree"]: r for r in chat.format_chats(messages).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("learned", chat.masked_text(F.col("formatted"), F.col("loss_mask"))).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("user", "hi"), ("assistant", "high"), ("user", "more"), ("assistant", "end")]
    assert out[1]["learned"] == "highend" and out[1]["path_score"] == 2.0
    assert [(t["role"], t["text"]) for t in out[2]["turns"]] == [("user", "")] and out[3]["turns"][0]["text"] == "self"
    assert len(out[4]["turns"]) == 1 and [t["text"] for t in out[5]["turns"]] == [str(k) for k in range(70)]
    assert chat.format_chats(messages, top_k=2).where("tree = 1").count() == 2
    assert chat.format_chats(messages.where("false")).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
def test_chat_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    expected = con.execute(queries.ORACLE["op10_chat"]).df().sort_values("conv_id").reset_index(drop=True)
    got = queries.QUERIES["op10_chat"](spark, SF).toPandas().sort_values("conv_id").reset_index(drop=True)
    assert got[expected.columns].astype(str).equals(expected.astype(str))


def test_counts_with_a_remainder_equal_the_library(spark, monkeypatch):
    lib = library()
    docs = spark.createDataFrame([*enumerate([*ODD_TEXTS, None, *TEXTS[1:]]), (3, "twice"), (None, "no id")], "doc_id long, text string")
    texts = [r["text"] or "" for r in docs.collect()]
    expected = sorted((len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for t in texts)
    for most, width in ((3, 48), (200_000, 2), (0, 48)):
        monkeypatch.setattr(bpe, "COMMON_MOST", most)
        monkeypatch.setattr(bpe, "COMMON_BYTES", width)
        assert sorted((r["n_bytes"], r["n_tokens"]) for r in bpe.count_tokens(docs).collect()) == expected


def test_pre_tokens_are_counted_once(spark):
    docs = spark.createDataFrame([(k, "one two two three" + " x" * (k % 3)) for k in range(50)], "doc_id long, text string").repartition(5)
    rows = bpe.distinct_pre_tokens(docs, "text", bpe.TOKENIZER).collect()
    assert len({r["piece"] for r in rows}) == len(rows) and {r["piece"]: r["n"] for r in rows}[" two"] == 100


def test_ids_may_be_strings(spark):
    docs = spark.createDataFrame([("a", "some words here of a text"), ("b", None), (None, "x")], "doc_id string, text string")
    for table in (bpe.count_tokens(docs), bpe.encode_documents(docs), repetition.repetition_rules(docs), licenses.scan_licenses(docs), jaccard.link_components(docs)):
        assert sorted(str(r["doc_id"]) for r in table.collect()) == ["None", "a", "b"]


def test_combs_and_odd_roles(spark):
    # a comb: each message on the way has a side reply; the way itself scores best
    rows = [(1, 0, None, "user", "0", 0.0)]
    for k in range(1, 40):
        rows += [(1, 2 * k, 2 * k - 2, ("user", "assistant")[k % 2], str(k), 1.0), (1, 2 * k + 1, 2 * k - 2, "side", "s", 0.5)]
    # a branching that hangs from a cycle
    rows += [(2, 0, 1, "user", "c", 0.0), (2, 1, 0, "user", "c", 0.0), (2, 2, 1, "user", "off", 0.0), (2, 3, 2, "user", "off", 0.0), (2, 4, 2, "user", "off", 0.0)]
    odd = ["a\\nb", "a\nb", "\\", "<s>\n\\n", "", None]
    rows += [(10 + k, 0, None, role, "text\\n\n", 0.0) for k, role in enumerate(odd)]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    out = {r["tree"]: r for r in chat.format_chats(messages).withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert [t["text"] for t in out[1]["turns"]] == [str(k) for k in range(40)] and out[1]["path_score"] == 39.0 and 2 not in out
    for k, role in enumerate(odd):
        assert [(t["role"], t["text"]) for t in out[10 + k]["turns"]] == [(role or "", "text\\n\n")]
    assert chat.format_chats(messages, top_k=100).where("tree = 1").count() == 40


def test_field_gradient_equals_finite_differences():
    draw = np.random.default_rng(1)
    size, time, batch = 4, 5, 3
    ids = draw.integers(0, size + 1, (time, batch, 3))
    present = np.ones((time, batch), bool)
    present[3:, 1] = present[1:, 2] = False
    tags = np.where(present, draw.integers(0, 2, (time, batch)), 0).astype(float)
    data = toxicity.Stretches(ids, tags, present, size)
    params = draw.normal(0, 0.7, size + 6)

    def likelihood(v):
        w, bias, start, moves = np.append(v[:size], 0.0), v[size], v[size + 1], v[size + 2 :].reshape(2, 2)
        total = 0.0
        for c in range(batch):
            n = int(present[:, c].sum())
            raw = bias + w[ids[:n, c]].sum(axis=1)
            value = lambda y: start * y[0] + sum(raw[k] * y[k] for k in range(n)) + sum(moves[a, b] for a, b in zip(y[:-1], y[1:], strict=True))  # noqa: B023, E731
            total += value(tags[:n, c].astype(int)) - np.logaddexp.reduce([value([p >> k & 1 for k in range(n)]) for p in range(1 << n)])
        return total / present.sum()

    got = toxicity.slope(params, data)
    for k in range(size + 6):
        step = np.zeros(size + 6)
        step[k] = 1e-5
        assert abs((likelihood(params + step) - likelihood(params - step)) / 2e-5 - got[k]) < 1e-6


def test_spans_are_places_in_the_text():
    model = toxicity.Crf({"wvilewort": 60.0}, -30.0)
    texts = ["İİİİ vilewort here", "VILEWORT", "clean words"]
    scores, spans = toxicity.score_texts(texts, model, toxicity.Scores(model))
    assert [[t[a:b] for a, b in own] for t, own in zip(texts, spans, strict=True)] == [["vilewort"], ["VILEWORT"], []]
    assert scores[0] > 0.9 and scores[2] < 0.1


def brute_bayes(rows, text):
    import math

    langs, counts = sorted({x for _, x in rows}), {}
    for t, x in rows:
        counts.setdefault(x, Counter()).update(langid.hashed_ngrams(t).tolist())
    logs = {}
    for x in langs:
        total = sum(counts[x].values()) + langid.SMOOTHING * langid.BUCKETS
        logs[x] = math.log(sum(y == x for _, y in rows) / len(rows)) + sum(math.log((counts[x][b] + langid.SMOOTHING) / total) for b in langid.hashed_ngrams(text).tolist())
    best = max(langs, key=lambda x: logs[x])
    return best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())


def test_languages_equal_brute_force_bayes(spark):
    draw = random.Random(8)
    word = lambda letters: "".join(draw.choices(letters, k=draw.randint(1, 6)))
    rows = [(" ".join(word(letters) for _ in range(draw.randint(1, 8))), x) for x, letters, n in (("aa", "abcdé", 12), ("bb", "abxyz", 30), ("cc", "cdxyß", 5)) for _ in range(n)]
    docs = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(docs, "text", "lang", key=F.col("doc_id"))
    tried = [t for t, _ in rows] + ["a", "x y", "ß", "dé ab", "zzz"]
    for t, name, score in zip(tried, *langid.score_block(tried, model), strict=True):
        best, chance = brute_bayes(rows, t)
        assert abs(score - chance) < 1e-3 and (name == best or chance < 0.501)


def test_samples_hold_every_label_at_any_size(spark):
    from pagequarry.llm.rows import label_shares, quota_sample

    counts = {"en": (10**11, 5), "rare": (3, 1 << 60), "mid": (10**6, 17)}
    shares = label_shares(counts, dict.fromkeys(counts, 5_000))
    assert shares["rare"] == (1 << 63) - 1 and shares["en"] / 2**63 * 10**11 == pytest.approx(5_000, rel=0.01)
    assert label_shares({"x": (10**30, 9)}, {"x": 1}) == {"x": 9}
    rows = spark.range(20_000).select(F.when(F.col("id") < 7, "few").otherwise("many").alias("label"), langid.hash63("id").alias("h"))
    found = {r["label"]: (r["n"], r["least"]) for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()}
    got = {r["label"]: r["count"] for r in quota_sample(rows, found, {"few": 100, "many": 100}, "label", "h").groupBy("label").count().collect()}
    assert got["few"] == 7 and 50 < got["many"] < 200
