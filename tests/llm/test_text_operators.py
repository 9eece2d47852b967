"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import datetime
import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from kvtable.llm import decontaminate, exact_dedup, jaccard_join, language_id, licenses, line_dedup, mixing, pii, quality, token_counts
from kvtable.llm.queries import ORACLES, QUERIES

UPPER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n", None, "b", 3),
    (4, "Ünïcode ÉTÉ 漢字 😀", "fr", None, 5),
    (5, LONG, "en", "a", 9),
    (6, LONG.upper(), "en", "a", 9),
    (7, "one", "en", "b", 3),
    (7, "one", "en", "b", 3),
    (None, "one", "en", "b", 3),
    (8, "12345 !!! ???", None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with extra columns whose names the operators use for themselves."""
    df = spark.createDataFrame(ODD, DOCS)
    for name in ("size", "key1", "row", "words", "bucket", "score", "kept", "start", "sid", "label", "set_id"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.mark.parametrize("name", ORACLES)
def test_query_agrees_with_duckdb(spark, name):
    from compare import DATA, agree

    agree(QUERIES[name](spark, str(DATA)), ORACLES[name])


def test_exact_dedup_cases(odd, empty):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(odd).collect()}
    assert got == {(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 4, 1, True), (5, 6, 2, False), (6, 6, 2, True), (7, 7, 3, True), (None, 7, 3, False), (8, 8, 1, True)}
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_reads_only_survivors(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "abc"), (4, "x" * 100 + "y"), (5, "x" * 100 + "z")], "doc_id long, text string")
    got = {r["doc_id"]: (r["group_size"], r["text_sha256"]) for r in exact_dedup.exact_dedup(df, buckets=1 << 30).collect()}
    assert got[1] == got[2] == (2, hashlib.sha256(b"aa").hexdigest())
    assert got[3] == (1, None) and got[4][0] == got[5][0] == 1 and got[4][1] != got[5][1]


# Quality


def test_quality_gradient():
    import numpy as np

    rng = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in quality.initial(1).items()}
    docs = [bytes(rng.integers(0, 255, n, dtype=np.uint8)) for n in (0, 5, 16, 17, 90)]
    y = np.array([1, 0, 1, 0, 1.0])

    def loss():
        p = quality.probability(quality.forward(docs, model)[3], model)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    found = quality.gradient(docs, y, model)
    for k, v in model.items():
        for at in rng.choice(v.size, min(6, v.size), replace=False):
            kept = v.flat[at]
            v.flat[at] = kept + 1e-6
            up = loss()
            v.flat[at] = kept - 1e-6
            down = loss()
            v.flat[at] = kept
            assert abs((up - down) / 2e-6 - found[k].flat[at]) < 1e-4


def test_quality_batches_do_not_change_scores():
    docs = [b"", b"abc", b"x" * 1000, LONG.encode(), b"The end."]
    model = quality.initial(3)
    assert quality.scores(docs, model) == pytest.approx([quality.scores([d], model)[0] for d in docs], abs=1e-6)


def test_quality_forward_against_single_chunks():
    import numpy as np

    model, rng = quality.initial(2), np.random.default_rng(3)
    model["bias"] = rng.standard_normal(quality.FILTERS).astype(np.float32)
    docs = [bytes(rng.integers(0, 255, n, dtype=np.uint8)) for n in (0, 3, 16, 17, 24, 400)]
    found = quality.forward(docs, model)[3]
    for text, pooled in zip(docs, found, strict=True):
        whole = quality.padded(text)
        chunks = [whole[s : s + quality.CHUNK] for s in range(0, len(whole) - quality.CHUNK + 1, quality.STRIDE)]
        best = np.max([np.concatenate([model["embedding"][c] for c in chunk]) @ model["filters"] for chunk in chunks], axis=0)
        assert pooled == pytest.approx(np.maximum(best + model["bias"], 0), abs=1e-4)


def test_quality_on_held_out_documents(spark):
    data = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]]) for r in quality.op2(spark, data).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert len(good) > 30 and len(bad) > 10
    area = sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    assert area > 0.75


def test_quality_learns(spark):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(400):
        words = " ".join(rng.choice(["river", "stone", "light", "and", "the"]) for _ in range(40))
        good = i % 4 != 0
        rows.append((i, words if good else words.upper() + " $$$"))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs.filter("doc_id < 300"), spark.createDataFrame(labels, "doc_id long, quality int"), rounds=3)
    scored = {r["doc_id"]: r["score"] for r in quality.score(docs.filter("doc_id >= 300"), model).collect()}
    assert all((s >= 0.7) == (i % 4 != 0) for i, s in scored.items()) and len(scored) == 100


def test_quality_cases(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(odd, none) is None
    assert {r["score"] for r in quality.score(odd, None).collect()} == {0.5}
    scored = quality.score(odd, quality.initial(1)).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.score(empty, quality.initial(1)).count() == 0


# Token counts


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_tokenizer())


def test_token_counts_equal_the_library(spark, docs, odd, empty):
    lib = library()
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(df).collect())
        ids = [len(lib.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows]
        assert got == Counter((r["doc_id"], len((r["text"] or "").encode()), n, n > 512) for r, n in zip(rows, ids, strict=True))
    assert token_counts.token_counts(empty).count() == 0


def test_every_prefix_is_exact(spark):
    lib, own = library(), token_counts.counter(token_counts.default_tokenizer())
    rng = random.Random(5)
    parts = ["'", "r", "e", "v", " ", "  ", "\n", "a", "the", "1", "<|endoftext|>", "<|end", "é", "!", "'s", "　", "ll", "😀", "\t", "ß", "՘"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert own.prefix_counts(text) == [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)], repr(text)
    df = spark.createDataFrame([(1, "the cat sat on the mat")], "doc_id long, text string")
    row = token_counts.token_counts(df, limit=3, prefixes=True).first()
    assert row["prefix_tokens"][-1] == row["n_tokens"] == 6 and row["prefix_tokens"][row["fit_chars"]] == 3


def test_fitting_is_the_longest_prefix():
    own = counter = token_counts.counter(token_counts.default_tokenizer())
    rng = random.Random(6)
    parts = ["'", "re", " ", "  ", "\n", "the ", "1", "<|endoftext|>", "<|end", "é", "!", "'ll", "　", "words ", "\t"]
    for _ in range(200):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        counts = own.prefix_counts(text)
        for budget in (0, 1, 2, 5, len(counts)):
            assert counter.fitting(text, budget) == max(i for i, n in enumerate(counts) if n <= budget), (text, budget)


def test_words_split_as_in_the_library():
    own, split = token_counts.counter(token_counts.default_tokenizer()), library().pre_tokenizer.pre_tokenize_str
    for cp in [*range(0x3000), *range(0x3000, 0x110000, 37)]:
        if not 0xD800 <= cp < 0xE000:
            text = f"a{chr(cp)}1 {chr(cp)}b"
            assert own.split(text) == [text[i:j] for _, (i, j) in split(text)], hex(cp)


# Language


def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = ["▁", "▁a", "▁ab", "a", "b", "ab", "ba"]
    own = language_id.Segmenter(pieces)
    p = np.zeros((len(pieces) + 2, 2))
    p[: len(pieces)] = np.random.default_rng(0).random((len(pieces), 2))
    p[len(pieces)] = language_id.UNKNOWN

    def total(word, lang, counts=None, taken=()):
        """All segmentations, one by one."""
        if not word:
            weight = np.prod([p[i, lang] for i in taken])
            if counts is not None:
                for i in taken:
                    counts[i] += weight
            return weight
        found = [(pieces.index(word[:k]), k) for k in range(1, 9) if word[:k] in pieces and k <= len(word)]
        if word[0] not in pieces:
            found.append((len(pieces), 1))
        return sum(total(word[k:], lang, counts, (*taken, i)) for i, k in found)

    words = ["a", "ab", "abab", "bab", "axb"]
    assert np.exp(own.scores(words, p)) == pytest.approx(np.array([[total("▁" + w, g) for g in (0, 1)] for w in words]))
    for lang in (0, 1):
        counts, weights = np.zeros(len(p)), np.zeros((1, 2))
        whole = total("▁abab", lang, counts)
        weights[0, lang] = 1
        assert own.expected(["abab"], weights, p)[:, lang] == pytest.approx(counts / whole)


def test_long_words_and_pieces_count_whole():
    import math
    from fractions import Fraction

    import numpy as np

    pieces = ["▁", "▁a", "a", "b", "ab", "abababababab"]
    own = language_id.Segmenter(pieces)
    p = np.zeros((len(pieces) + 2, 2))
    p[: len(pieces)] = np.random.default_rng(0).random((len(pieces), 2)) / 20
    p[len(pieces)] = language_id.UNKNOWN
    words = ["ab" * 6, "ab" * 19, "ab" * 21, "ab" * 25 + "x", "b" * 300, "ab" * 700, "a" * 41]

    def exact(word, lang):
        """Forward and backward sums of exact fractions, the logarithm of the whole and the expected counts."""
        text, n = "▁" + word, len(word) + 1
        steps = [[(i, len(x)) for i, x in enumerate(pieces) if text.startswith(x, at)] or [(len(pieces), 1)] for at in range(n)]
        steps = [s if any(k == 1 for _, k in s) else [*s, (len(pieces), 1)] for s in steps]
        ahead, back = [Fraction(1)] + [Fraction(0)] * n, [Fraction(0)] * n + [Fraction(1)]
        for at in range(n):
            for i, k in steps[at]:
                ahead[at + k] += ahead[at] * Fraction(p[i, lang])
        for at in reversed(range(n)):
            back[at] = sum(Fraction(p[i, lang]) * back[at + k] for i, k in steps[at])
        counts = np.zeros(len(p))
        for at in range(n):
            for i, k in steps[at]:
                counts[i] += float(ahead[at] * Fraction(p[i, lang]) * back[at + k] / ahead[n])
        return math.log(ahead[n].numerator) - math.log(ahead[n].denominator), counts

    expected = [[exact(w, g) for g in (0, 1)] for w in words if len(w) <= 300]
    got = own.scores(words, p)
    assert got[[len(w) <= 300 for w in words]] == pytest.approx(np.array([[e[0] for e in row] for row in expected]))
    assert np.isfinite(got).all()
    short = [w for w in words if len(w) <= 300]
    assert own.expected(short, np.ones((len(short), 2)), p) == pytest.approx(sum(np.stack([row[0][1], row[1][1]], axis=1) for row in expected))


def test_language_accuracy_on_held_out_documents(spark, docs):
    from compare import DATA

    found = {r["doc_id"]: r for r in language_id.op4(spark, str(DATA)).collect()}
    held = [r for r in docs.collect() if found[r["doc_id"]]["held_out"]]
    assert len(held) > 20 and sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_cases(spark, odd, empty):
    model = language_id.fit(odd)
    assert model.languages == ["en", "fr"]
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(odd, model).collect()]
    assert {(i, s) for i, g, s in got if g == "und"} == {(1, 0.0), (2, 0.0), (3, 0.0), (8, 0.0)} and len(got) == len(ODD)
    assert {r["lang_pred"] for r in language_id.predict(odd, language_id.fit(empty)).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


# Licenses


def spans(words, phrase):
    phrase = phrase.split()
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def test_licenses(spark, docs, odd, empty):
    more = spark.createDataFrame(
        [
            (100, "CC-BY cc by. All rights reserved; ALL RIGHTS RESERVED", None, None, 0),
            (101, "Licensed under the Apache License, Version 2.0 (the notice)", None, None, 0),
            (102, "apache license of another version 2", None, None, 0),
            (103, "under the GNU General Public License, version 3.", None, None, 0),
            (104, "cc " * 50 + "by", None, None, 0),
            (105, "license agreement and restriction of charge, all of general rights", None, None, 0),
            (106, "charge, free of charge to any person: permission is hereby granted free of charge to any person obtaining a copy of this Software and", None, None, 0),
        ],
        DOCS,
    )
    for df in (docs, odd, more):
        found = [(r["doc_id"], r["n_words"], tuple(sorted((x["start"], x["label"]) for x in r["found"] if x["is_base"]))) for r in licenses.scan(df).collect()]
        expected = []
        for r in df.select("doc_id", "text").collect():
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(UPPER))
            expected.append((r["doc_id"], len(words), tuple(sorted((i, label) for phrase, label in licenses.BASE for i in spans(words, phrase)))))
        assert Counter(found) == Counter(expected)
    labels = {r["doc_id"]: {x["label"] for x in r["found"]} for r in licenses.scan(more).collect()}
    assert labels == {100: {"cc-by", "reserved"}, 101: {"apache-2.0"}, 102: set(), 103: {"gpl", "gpl-3.0"}, 104: {"cc-by"}, 105: set(), 106: {"mit"}}
    assert licenses.scan(empty).count() == 0


def test_license_templates_against_all_places(spark):
    """Every template whole, and with words lost, changed and doubled, against a look at every place."""
    rng = random.Random(5)
    templates = licenses.listed(licenses.BASE, licenses.TEMPLATES, 0.6)
    texts = [" ".join(words) for _, _, words, _, _ in templates]
    for _, _, words, _, _ in templates * 3:
        altered = [w for word in words for w in rng.choice([[word]] * 8 + [["other"], [], [word, word]])]
        texts.append(" ".join(["the software"] * rng.randrange(3) + altered + rng.choice(templates)[2]))
    found = {r["doc_id"]: sorted((x["start"], x["label"], x["is_base"], x["score"]) for x in r["found"]) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        own, expected = text.split(), []
        for label, is_base, words, key, need in templates:
            for start in range(-len(words), len(own)):
                there = [0 <= start + j < len(own) and own[start + j] == w for j, w in enumerate(words)]
                if all(there[k] for k in key) and sum(there) >= need:
                    expected.append((start, label, is_base, sum(there) / len(words)))
        assert found[i] == sorted(expected)
        assert i >= len(templates) or (0, *templates[i][:2], 1.0) in found[i]


# Mixing


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    df = mixing.permuted(spark.range(n), "p", F.col("id"), F.lit(n).cast("long"), F.lit(5))
    assert sorted(r["p"] for r in df.collect()) == list(range(n))


@pytest.mark.parametrize("n", [1, 2, 97, 10_007, 999_983, 10**9 + 7])
def test_grid_has_few_spare_cells(n):
    a, b = mixing.grid(n)
    assert n <= a * b <= n + max(1, n**0.5 / 50) and a <= b <= 17 * a + 1


def test_alias_table_draws_by_weight():
    weights = [5, 0, 1, 100, 7, 7]
    chance = [0.0] * len(weights)
    for column, p, other in mixing.alias_table(weights):
        chance[column] += p / len(weights)
        chance[other] += (1 - p) / len(weights)
    assert chance == pytest.approx([w / sum(weights) for w in weights])


def test_shards_draw_their_sources(spark):
    rows = [(i, " ".join(["w"] * 100), f"s{i % 3}") for i in range(600)]
    made = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=4, shard_slots=100)
    plan = {r["sid"]: r["slots"] for r in made.sources.collect()}
    total, drawn = sum(plan.values()), defaultdict(Counter)
    for r in made.slots.collect():
        drawn[r["shard"]][r["sid"]] += 1
    assert Counter({s: sum(c[s] for c in drawn.values()) for s in plan}) == Counter(plan)
    early = [drawn[k] for k in range(total // 100 // 2)]  # far from where totals are made up for
    for sid, n in plan.items():
        p, counts = n / total, [c[sid] for c in early]
        mean = sum(counts) / len(counts)
        spread = sum((x - mean) ** 2 for x in counts) / len(counts)
        assert abs(mean - 100 * p) < 3 and 0.6 < spread / (100 * p * (1 - p)) < 1.6  # as a multinomial draw has it


def test_targets():
    assert mixing.targets([100, 100, 100], 1.5, 2, [3, 1, 2]) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([0, 0], 1.5, 2, [3, 1]) == [0.0, 0.0]
    assert mixing.targets([], 1.5, 2, []) == []
    assert mixing.targets([10, 1000], 1.5, 2, [3, 1]) == [20.0, 1495.0]


def test_mixing(docs, odd, empty):
    for df in (docs, odd):
        rows = df.select("doc_id", "text", "source").collect()
        mixed = mixing.mix(df, block_words=16, shard_slots=64)
        taken = mixed.taken.collect()
        sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows]
        assert Counter((r["doc_id"], r["size"]) for r in taken) == Counter((r["doc_id"], n) for r, n in zip(rows, sizes, strict=True))
        by_source = defaultdict(list)
        for r in taken:
            by_source[r["source"]].append(r)
            assert 0 <= r["taken"] <= 2 * r["size"]
        for own in by_source.values():
            assert own[0]["source_size"] == sum(r["size"] for r in own)
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        again = mixing.mix(df, block_words=16, shard_slots=64).taken.collect()
        assert Counter(map(tuple, again)) == Counter(map(tuple, taken))
        slots = mixed.slots.collect()
        whole = [(s["sid"], s["slot"]) for s in slots]
        assert len(set(whole)) == len(whole) and all(s["block"] >= 0 for s in slots)
    assert mixing.mix(empty).taken.count() == 0


def test_mixing_gives_the_mix(docs, odd, empty):
    for df in (docs, odd):
        made = mixing.mix(df, block_words=16, shard_slots=64)
        rows, plan = made.mixed.collect(), {r["sid"]: r for r in made.sources.collect()}
        own = defaultdict(list)
        for r in df.select("text", "source").collect():
            own[r["source"]].append(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        by_source, blocks, shards = defaultdict(list), {}, Counter()
        for r in rows:
            words = r["text"].split(" ")
            by_source[r["sid"]].append(r)
            shards[r["shard"]] += 1
            assert r["text"] == " ".join(p["text"] for p in r["pieces"]) and 1 <= len(words) <= 16
            longest = blocks.setdefault((r["sid"], r["block"]), words)
            assert longest[: len(words)] == words[: len(longest)]  # a block is the same each time, but for the cut last one
            blocks[r["sid"], r["block"]] = max(longest, words, key=len)
        slots = {(s["sid"], s["slot"]): (s["shard"], s["block"]) for s in made.slots.collect()}
        assert {(r["sid"], r["slot"]): (r["shard"], r["block"]) for r in rows} == slots and len(rows) == len(slots)
        assert max(shards.values()) <= 64 and sum(n == 64 for n in shards.values()) > len(rows) // 64 * 0.6
        spans = Counter((x["shard"], x["sid"], x["slot"], x["block"], x["left"], x["start"], x["n"]) for x in made.spans.collect())
        assert spans == Counter((r["shard"], r["sid"], r["slot"], r["block"], p["left"], p["start"], len(p["text"].split(" "))) for r in rows for p in r["pieces"])
        assert Counter(s["sid"] for s in made.slots.collect()) == Counter({i: p["slots"] for i, p in plan.items() if p["slots"]})
        for sid, p in plan.items():
            assert sum(len(r["text"].split(" ")) for r in by_source[sid]) == p["words"]
            if p["epochs"] >= 1:  # all words of the source, as often as they stand in it
                whole = Counter(w for (i, _), words in blocks.items() if i == sid for w in words)
                assert whole == Counter(w for words in own[p["source"]] for w in words)
        assert sum(r["taken"] for r in made.taken.collect()) == sum(p["words"] for p in plan.values())
    assert mixing.mix(empty).mixed.count() == 0


# Jaccard join


def brute_components(rows):
    sets, first = [], defaultdict(list)
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    for i, s in enumerate(sets):
        for x in s:
            first[x].append(i)
    both = Counter((a, b) for own in first.values() for k, a in enumerate(own) for b in own[k + 1 :])
    group = list(range(len(sets)))
    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n) and group[a] != group[b]:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[group[i]].append(doc)
    return Counter((doc, len(sets[i]), min(ids[group[i]], default=None)) for i, (doc, _) in enumerate(rows))


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def test_jaccard_join(spark, docs, odd, empty):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    passage = [rng.choice(vocabulary) for _ in range(40)]
    for base in range(6):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([6, 12, 30, 150, 300]))]
        rows += [edited(rng, words, rng.randrange(0, max(1, len(words) // 12))) for _ in range(25)]
    rows += [" ".join([*(rng.choice(vocabulary) for _ in range(100)), *passage]) for _ in range(60)]  # a shared passage links nothing
    rows += [" ".join(rng.choice(vocabulary[:3]) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    synthetic = spark.createDataFrame([(i * 7 % 1009, t) for i, t in enumerate(rows)], "doc_id long, text string")
    for df in (synthetic, docs, odd):
        expected = brute_components([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(df).collect())
        assert got == expected
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_partenum_loses_no_pair():
    import numpy as np

    from kvtable.llm.partenum import TAG_MASK, Bands, signatures

    rng = np.random.default_rng(1)
    bands = Bands(4, 5)
    for size in [*range(1, 60), 100, 333, 1000]:
        for _ in range(4):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            out = int(rng.integers(0, size // 9 + 1))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[out:]], rng.integers(0, 2**64, out, dtype=np.uint64)]))
            n = len(np.intersect1d(a, b))
            if 5 * n >= 4 * (len(a) + len(b) - n):
                sigs, owner, of, tags, least = signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), bands)
                common = Counter((np.intersect1d(sigs[owner == 0], sigs[owner == 1]) & np.uint64(TAG_MASK)).tolist())
                assert common and all(common[t] >= k for i, t, k in zip(of, tags, least, strict=True) if i == 0 and t in tags[of == 1])


def test_shingles_do_not_depend_on_batches_or_slices(monkeypatch):
    import numpy as np

    from kvtable.llm import partenum, wordhash

    rng = random.Random(2)
    texts = ["".join(rng.choice(["ab", "C", " ", "\t", "d\n", "é", "word"]) for _ in range(rng.randrange(40))).encode() for _ in range(300)] + [b"x" * 3000 + b" y z"]

    def sets(group):
        return partenum.shingle_sets(np.frombuffer(b"".join(group), np.uint8), np.cumsum([0, *map(len, group)]), 3)

    single = [sets([t]) for t in texts]
    for cut in (wordhash.SLICE, 64):
        monkeypatch.setattr(wordhash, "SLICE", cut)
        elements, sizes = sets(texts)
        assert sizes.tolist() == [n.sum() for _, n in single] and (elements == np.concatenate([e for e, _ in single])).all()
    words = [t.decode().translate(UPPER).split() for t in texts]
    assert sizes.tolist() == [len({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}) if w else 0 for w in words]


def test_components(spark):
    from kvtable.llm.components import components

    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, 200 + i) for i in range(1, 30)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "left long, right long")).collect()}
    group = {x: x for e in edges for x in e if e[0] != e[1]}
    for a, b in edges:
        if a != b:
            old, new = group[b], group[a]
            group = {k: new if g == old else g for k, g in group.items()}
    assert found.keys() == group.keys() and len(set(found.values())) == len(set(group.values()))
    assert len({(found[x], g) for x, g in group.items()}) == len(set(found.values()))
    assert components(spark.createDataFrame([], "left long, right long")).count() == 0


# Lines


def test_line_dedup(spark, odd, empty):
    line = lambda n, k=30: " ".join(f"l{n}w{i}" for i in range(k))
    passage = "\n".join(f"short line {n} of one passage here" for n in range(12))
    rows = [
        (1, f"{line(1)}\n{line(2)}"),
        (2, f"{line(3)}\n{line(2)}\nfine"),
        (3, f"{line(2)}"),
        (4, f"{line(5)}\n{passage}\n{line(6)}"),
        (5, f"{line(7)}\n{passage}\n{line(8)}"),
        (6, "fine\nfine"),
        (7, f"{line(9)}\n{line(9)}"),
    ]
    found = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = {i: r["text"] for i, r in found.items()}
    assert text[1] == rows[0][1] and text[4] == rows[3][1] and text[6] == "fine\nfine"
    assert text[2] == f"{line(3)}\nfine" and text[3] == "" and text[7] == line(9)
    assert text[5].startswith(line(7)) and text[5].endswith(line(8)) and len(text[5].split("\n")) <= 6
    assert found[7]["n_removed"] == 1 and found[7]["words_removed"] == 30
    got = Counter((r["doc_id"], r["text"]) for r in line_dedup.line_dedup(odd).collect())
    assert got == Counter((r[0], r[1]) for r in ODD)
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_against_counting(docs, texts):
    chunker = line_dedup.Chunker(25, 10)
    first, expected = {}, {}
    for i in sorted(texts):
        lines = texts[i].encode().split(b"\n")
        kept = []
        for c in chunker.cut(lines):
            chunk = b"\n".join(lines[c[0] : c[1]])
            if not chunker.counts(c) or first.setdefault(chunk, (i, c[0])) == (i, c[0]):
                kept.append(chunk)
        expected[i] = b"\n".join(kept).decode()
    assert {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs).collect()} == expected


def test_line_dedup_finds_passages_of_middling_lines_whole(spark, odd):
    rng = random.Random(8)
    line = lambda k: " ".join(f"v{rng.randrange(10**6)}" for _ in range(k))
    rows, kept = [], {}
    for case, (lines, k) in enumerate([(3, 20), (4, 15), (5, 12), (20, 12), (12, 7), (30, 2)] * 4):
        passage = [line(k) for _ in range(lines)]
        for copy in range(3):
            before, after = [line(rng.randrange(1, 24)) for _ in range(3)], [line(rng.randrange(1, 24)) for _ in range(3)]
            i = case * 3 + copy
            rows.append((i, "\n".join([*before, *passage, *after])))
            kept[i] = "\n".join([*before, *(passage if copy == 0 else []), *after])
    rows += [(1000, "\n".join(["a line of twelve words that comes again and again and again"] * 9)), (1001, f"{line(12)}\nthe same line by itself is no passage at all")]
    rows += [(1002, f"{line(12)}\nthe same line by itself is no passage at all")]
    kept |= {1000: "a line of twelve words that comes again and again and again", 1001: rows[-2][1], 1002: rows[-1][1]}
    found = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), passages=True).collect()}
    assert {i: r["text"] for i, r in found.items()} == kept
    assert all(r["words_removed"] == len(dict(rows)[i].split()) - len(r["text"].split()) and (r["n_removed"] > 0) == (r["words_removed"] > 0) for i, r in found.items())
    got = Counter((r["doc_id"], r["text"]) for r in line_dedup.line_dedup(odd, passages=True).collect())
    assert got == Counter((r[0], r[1]) for r in ODD)


# Personal data


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pseudonyms(spark, odd, empty):
    rows = [
        "mail und.34@mail7.example.com.",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###',
        "+1 (017) 555-7713",
        "4845168114407329 4845-1681-1440-7329 but 9807915762804490",
        "152.143.123.131### not 999.1.1.1",
        "123-45-6789 not 000-12-1234",
        "2024-02-29 not 2023-02-29",
        "GB82 WEST 1234 5698 7654 32",
        "9807915762804490 4845168114407329",
        "plain words, 12 of them",
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.pseudonymise(df, key="k").collect()}
    kinds = {i: [x["kind"] for x in r["found"]] for i, r in found.items()}
    assert kinds == {0: ["email"], 1: ["secret"], 2: ["phone"], 3: ["card", "card"], 4: ["ip"], 5: ["ssn"], 6: ["date"], 7: ["iban"], 8: ["card"], 9: []}
    for i, r in found.items():
        assert all(x["original"] not in r["text"] for x in r["found"])
        assert i in (0, 7) or re.sub(r"[0-9a-f]", "9", r["text"]) == re.sub(r"[0-9a-f]", "9", rows[i]) or i == 4
    a, b = re.findall(r"[\d-]+", found[3]["text"])[:2]
    assert a == b.replace("-", "") and luhn(a) and a in found[8]["text"]
    assert "9807915762804490" in found[3]["text"] and "999.1.1.1" in found[4]["text"] and "2023-02-29" in found[6]["text"]
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, key="another").collect()}
    assert other[3] != found[3]["text"] and other[9] == rows[9]
    again = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, key="k").collect()}
    assert again == {i: r["text"] for i, r in found.items()}
    assert Counter((r["doc_id"], r["text"]) for r in pii.pseudonymise(odd, key="k").collect()) == Counter((r[0], r[1]) for r in ODD)
    assert pii.pseudonymise(empty, key="k").count() == 0


def test_pseudonyms_without_digits_and_with_letters(spark):
    ibans = ["MT84 MALT 0110 0001 2345 MTLC AST0 01S", "MU17BOMM0101101030300200000MUR", "FR1420041010050500013M02606", "SC18SSCB11010000000000001497USD"]
    secret = 'password = "correcthorsebatterystaple"'
    rows = [*ibans, f"{secret} here", f"{secret} and 7", f'"{"abcdefAB" * 4}"', "the password: none of it"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.pseudonymise(df, key="k").collect()}
    rest = lambda text: int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97
    for i, was in enumerate(ibans):
        now = found[i]["text"]
        assert [x["kind"] for x in found[i]["found"]] == ["iban"] and rest(now.replace(" ", "")) == 1
        shape = lambda text: re.sub("[A-Z]", "A", re.sub("[0-9]", "9", text))
        assert shape(now) == shape(was) and now[:2] == was[:2]
        for a, b in zip(re.findall(r"\d{4,}|[A-Z]{3,}", was.replace(" ", "")[4:]), re.findall(r"\d{4,}|[A-Z]{3,}", now.replace(" ", "")[4:]), strict=True):
            assert a != b
    assert [[x["kind"] for x in found[i]["found"]] for i in (4, 5, 6, 7)] == [["secret"], ["secret"], ["secret"], []]
    assert found[4]["found"][0]["text"] == found[5]["found"][0]["text"] and "horse" not in found[4]["text"] and found[7]["text"] == rows[7]


class Pseudonyms:
    """The same rules in plain Python, a text and a find at a time."""

    def __init__(self, key):
        self.key = key

    def sha(self, *parts):
        return hashlib.sha256("|".join([self.key, *map(str, parts)]).encode()).hexdigest()

    def network(self, left, right, a, b, kind):
        for i in range(4):
            left = (left + int(self.sha(f"{kind}{2 * i}", a, b, right)[:15], 16) % a) % a
            right = (right + int(self.sha(f"{kind}{2 * i + 1}", a, b, left)[:15], 16) % b) % b
        return left, right

    def number(self, x, a, b, kind):
        left, right = self.network(*divmod(x, b), a, b, kind)
        return left * b + right

    def run(self, text, kind):
        base, of = (10, int) if text.isdigit() else (26, lambda t: sum((ord(c) - 65) * 26**i for i, c in enumerate(reversed(t))))
        high = (len(text) + 1) // 2
        low = len(text) - high
        halves = self.network(of(text[:high]), of(text[high:]) if low else 0, base**high, base**low, kind)
        shown = lambda x, n: "".join((str if base == 10 else lambda d: chr(65 + d))(x // base**i % base) for i in reversed(range(n)))
        return shown(halves[0], high) + shown(halves[1], low)

    def fill(self, shape, text, kept=str.isdigit):
        rest = iter(text)
        return "".join(next(rest) if kept(c) else c for c in shape)

    def one(self, m):
        digits = re.sub("[^0-9]", "", m)
        whole = lambda pattern: re.fullmatch(pattern, m)
        secret = re.search(f"(?:[=:]{pii.BETWEEN}|^\")([A-Za-z0-9_+/-]{{16,}})[\"']?$", m)
        if "@" in m:
            local, domain = m.lower().split("@")
            return "email", f"{self.sha('email', local, domain)[:32]}@mail.invalid"
        if secret:
            value = secret[1]
            return "secret", m.replace(value, "".join(self.sha(f"secret{i}", value) for i in range(4))[: len(value)])
        if re.match("[A-Z]{2}[0-9]{2}", m):
            compact = m.replace(" ", "")
            rest = lambda text: int("".join(str(int(c, 36)) for c in text)) % 97
            if rest(compact[4:] + compact[:4]) != 1:
                return None, m
            made = "".join(self.run(x, "iban") for x in re.findall("[0-9]{1,18}|[A-Z]{1,18}", compact[4:]))
            return "iban", self.fill(m, f"{compact[:2]}{98 - rest(made + compact[:2] + '00'):02d}{made}", lambda c: c != " ")
        if whole(pii.DATE):
            for form in ("%Y-%m-%d",) if m[4] == "-" else ("%d/%m/%Y", "%m/%d/%Y"):
                try:
                    day = datetime.datetime.strptime(m, form).date()
                except ValueError:
                    continue
                start = datetime.date(1900, 1, 1)
                return "date", (start + datetime.timedelta(self.number((day - start).days, 17, 4297, "date"))).strftime(form)
            return None, m
        if whole(pii.IP):
            parts = [int(x) for x in m.split(".")]
            if max(parts) > 255:
                return None, m
            x = self.number(sum(p << 8 * (3 - i) for i, p in enumerate(parts)), 65536, 65536, "ip")
            return "ip", ".".join(str(x >> 8 * i & 255) for i in (3, 2, 1, 0))
        if whole(pii.SSN):
            area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
            if not 0 < area < 900 or area == 666 or not group or not serial:
                return None, m
            x = self.number(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn")
            area = x // (99 * 9999)
            return "ssn", f"{area + 1 + (area >= 665):03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"
        if whole("[0-9](?:[ -]?[0-9]){12,18}"):
            if not luhn(digits) or len(set(digits)) == 1:
                return None, m
            body = self.run(digits[:-1], "card")
            return "card", self.fill(m, body + next(d for d in "0123456789" if luhn(body + d)))
        if 7 <= len(digits) <= 17:
            kept = (re.match(pii.COUNTRY, m) or [""])[0]
            return "phone", kept + self.fill(m[len(kept) :], self.run(digits[max(0, len(kept) - 1) :], "phone"))
        return None, m

    def text(self, text):
        kinds = []

        def change(m):
            kind, made = self.one(m[0])
            kinds.extend([kind] if kind else [])
            return made

        return re.sub(pii.PATTERN, change, text, flags=re.ASCII), kinds


def test_pseudonyms_against_plain_python(spark, docs):
    rng = random.Random(9)
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made = [f"{digit(3)}-{digit(2)}-{digit(4)}, {digit(2)}/{digit(2)}/20{digit(2)} 19{digit(2)}-0{digit(1)}-1{digit(1)}; {rng.randrange(300)}.{rng.randrange(300)}.1.7" for _ in range(150)]
    made += [f"call +{digit(2)} {digit(3)} {digit(4)} {digit(2)} or ({digit(3)}) {digit(3)}-{digit(4)}; a.{digit(2)}@x-{digit(1)}.co.uk. {digit(4)} {digit(4)} {digit(4)} {digit(4)}" for _ in range(150)]
    made += ["IBAN GB82 WEST 1234 5698 7654 32.", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "Token: 'abcdefghijklmnop_q'", f'"{"0aF9" * 9}"', "x@y.z a@b.cd", "4845168114407329", "1111111111111111"]
    rows = [r["text"] for r in docs.select("text").collect()] + made
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    own, kinds = Pseudonyms("k"), Counter()
    for r in pii.pseudonymise(df, key="k").collect():
        text, found = own.text(rows[r["doc_id"]]) if rows[r["doc_id"]] is not None else (None, [])
        assert r["text"] == text and [x["kind"] for x in r["found"]] == found
        kinds.update(found)
    assert set(kinds) == {"email", "secret", "iban", "date", "ip", "ssn", "card", "phone"}


@pytest.mark.parametrize("part", ["a1B2", "a.", "1", ".", '"', "1 ", "1-", "@", "a@", "x1@a.", "token", "token=", "+1 (", "A1", "GB82 ", "- "])
def test_patterns_take_long_texts(spark, part):
    text = "x1@" * (part == "a.") + part * (1_000_000 // len(part)) + "!"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    found = pii.pseudonymise(df, key="k").collect()
    assert len(found) == 1 and (found[0]["text"] == text or found[0]["found"]) and time.time() - began < 20


def test_pseudonyms_need_a_key(spark, odd):
    with pytest.raises(TypeError):
        pii.pseudonymise(odd)
    assert len(pii.session_key(spark)) >= 32 and pii.session_key(spark) == pii.session_key(spark)


def test_letters_permute(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3):
        all_ = spark.range(26**n).select(F.concat(*(F.char(F.pmod(F.floor(F.col("id") / 26**i), F.lit(26)) + 65) for i in range(n))).alias("x"))
        made = all_.select(pii.permuted_letters(F.col("x"), "k", "x").alias("p")).distinct()
        assert made.count() == 26**n == made.filter(f"length(p) = {n} AND p RLIKE '^[A-Z]+$'").count()


def test_networks_permute(spark):
    from pyspark.sql import functions as F

    n = spark.range(1000).select(pii.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "x").alias("p")).distinct()
    assert n.count() == 1000 and n.filter("length(p) = 3").count() == 1000
    days = spark.range(pii.DAYS).select(pii.feistel(F.col("id"), F.lit(17), F.lit(4297), "k", "date").alias("p")).distinct()
    assert days.count() == pii.DAYS and days.agg(F.max("p")).first()[0] == pii.DAYS - 1


# Decontamination


def test_decontamination(spark, docs, odd, empty):
    item = " ".join(f"b{i}" for i in range(20))
    benchmark = [(1, item), (2, "one"), (3, None), (4, "!!"), (None, "nobody lists this item at all"), (1, "a second text of item one is here")]
    rows = [
        (10, f"x y {' '.join(item.split()[2:16]).upper()}, z"),
        (11, f"{item} {item}"),
        (12, " ".join(item.split()[:12])),
        (13, " ".join(["filler"] * 500 + item.split()[:13])),
        (14, "Nobody lists this item at all"),
        (15, "b0 b1 b2 b3 b4 b5 zz b6 b7 b8 b9 b10 b11 b12"),
    ]
    bench = spark.createDataFrame(benchmark, "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.decontaminate(df, bench).collect()}
    assert got == {10: (17, 14, ["1"], True), 11: (40, 40, ["1"], True), 12: (12, 0, [], False), 13: (513, 13, ["1"], False), 14: (6, 6, [], True), 15: (14, 0, [], False)}
    near = {r["doc_id"]: r["near_items"] for r in decontaminate.decontaminate(df, bench, anchors=13, slop=1).collect()}
    assert near[15] == ["1"] and near[12] == []
    found = {(r["doc_id"], r["n_hit"], tuple(r["items"])) for r in decontaminate.decontaminate(odd, bench).collect()}
    assert {(7, 1, ("2",)), (None, 1, ("2",)), (1, 0, ()), (5, 0, ())} <= found
    assert decontaminate.decontaminate(empty, bench).count() == 0
    clean = decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"))
    assert clean.filter("contaminated").count() == 0 and clean.count() == docs.count()
