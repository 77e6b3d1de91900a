"""Token counts, preference pairs and decontamination."""

import random

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.decontamination import contaminated, drop_contaminated, matches, myers, prepare
from quire.llm.preference import OP9_SQL, neighbour_pairs
from quire.llm.token_counts import TOKENIZER, length_histogram, length_quantile, load_encoder, suffix_sums, truncated_total


def test_histogram_matches_single_encoding(spark, documents, odd, empty):
    with open(TOKENIZER, "rb") as file:
        encode = load_encoder(file.read()).encode_ordinary
    for docs in (documents, odd):
        lengths = sorted(len(encode(r.text or "")) for r in docs.select("text").collect())
        sums = suffix_sums(length_histogram(docs))
        for r in sums.collect():
            assert r.n_docs == lengths.count(r.n_tokens)
            assert r.docs_at_least == sum(x >= r.n_tokens for x in lengths)
            assert r.truncated_total == sum(min(x, r.n_tokens) for x in lengths)
            assert r.tokens_at_most == sum(x for x in lengths if x <= r.n_tokens)
        for limit in (0, 1, 17, 512, 4096, 10**7):
            assert truncated_total(sums, limit) == sum(min(x, limit) for x in lengths)
        assert length_quantile(sums, 0.5) == lengths[(len(lengths) + 1) // 2 - 1]
    assert suffix_sums(length_histogram(empty)).count() == 0


def rows(df):
    return sorted(map(tuple, df))


def test_preference_matches_sql(spark, small):
    con = duckdb.connect()
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "system", "s"), (2, 1, "user", "a"), (3, 0, "system", "s"), (3, 1, "user", "a"), (3, 2, "assistant", "b"), (4, 0, "user", "alone"), (6, 0, None, None), (7, 0, None, ""), (8, 1, "user", "same"), (8, 1, "user", "same"), (9, 1, "user", "same"), (None, 0, "user", "lost")]
    odd = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, c string")
    for df in (spark.read.parquet(f"{small}/conversations.parquet"), odd, odd.where("false")):
        con.register("conversations", pa.Table.from_pandas(df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}), preserve_index=False))
        got = neighbour_pairs(df).collect()
        names = ["pair_id", "paired", "n_common", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask"]
        assert rows(tuple(r[n] for n in names) for r in got) == rows(con.execute(f"select {', '.join(names)} from ({OP9_SQL})").fetchall())
    got = {r.pair_id: r for r in neighbour_pairs(odd).collect()}
    assert got[0].n_common == 1 and "yes" in got[0].chosen and "no" in got[0].rejected and "hi" in got[0].prompt
    assert got[1].n_common == 2 and got[1].chosen == "" and not got[2].paired and got[3].n_common == 0 and got[4].n_common == 1


def test_masks_cover_completions(spark, small):
    for r in neighbour_pairs(spark.read.parquet(f"{small}/conversations.parquet")).collect():
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            runs = [tuple(map(int, x.split(":"))) for x in mask.split(",") if x]
            assert sum(n for n, _ in runs) == len(text)
            at, said = 0, ""
            for n, flag in runs:
                said += text[at : at + n] if flag else ""
                at += n
            assert "<|im_start|>" not in said


def edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=70).map(lambda b: bytes(97 + x % 3 for x in b)), st.binary(max_size=90).map(lambda b: bytes(97 + x % 3 for x in b)))
def test_myers(p, t):
    want = edit_distance(p, t)
    assert myers(p, t, len(p)) == want
    assert (myers(p, t, 2) is None) == (want > 2)


def test_every_match_within_the_budget_is_found():
    rng = random.Random(9)
    letters = "abcdefgh "
    make = lambda n: "".join(rng.choice(letters) for _ in range(n)).strip() or "a"
    items = [(i, make(n)) for i, n in enumerate([3, 9, 25, 60, 120, 200, 64, 40])]
    texts = [None, "", make(50)]
    for _, t in items:
        for edits in (0, 1, 2, 5, 12, 30):
            s = list(t)
            for _ in range(edits):
                at = rng.randrange(len(s))
                s[at : at + 1] = rng.choice(["", "z", s[at] + "y"])
            texts.append(make(80) + "  " + "".join(s).upper() + "\n" + make(70))
    table = prepare(items)
    got = {(r, table.ids[i]): d for r, i, d in matches(pa.array(texts, pa.string()), table)}
    norm = lambda t: " ".join((t or "").lower().split()).encode()
    for r, t in enumerate(texts):
        for i, item in items:
            p = norm(item)
            d = edit_distance(p, norm(t))
            if d <= int(0.1 * len(p)):
                assert got.pop((r, i)) >= d
    assert not got


def test_contaminated(spark, odd, empty):
    long = odd.where("doc_id = 9").first().text.split()
    bench = spark.createDataFrame([(1, " ".join(long[5000:5040]), "x"), (2, None, "x"), (None, "abc", "x"), (3, " ", "x"), (4, "not in any of the texts at all, and long", "x")], "item_id long, text string, doc_id string")
    assert {(r.doc_id, r.item_id, r.distance) for r in contaminated(odd, bench).collect()} == {(9, 1, 0)}
    assert {(r.doc_id, r.item_id) for r in contaminated(odd, bench, block_bytes=100).collect()} == {(9, 1)}
    assert drop_contaminated(odd, bench).count() == odd.count() - 2
    assert contaminated(odd, bench.where("false")).count() == 0 and contaminated(empty, bench).count() == 0 and drop_contaminated(empty, bench).count() == 0


@pytest.mark.parametrize("n", [1, 2])
def test_benchmark_copies_are_found(spark, documents, small, n):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    norm = lambda t: " ".join((t or "").lower().split())
    items = [(r.item_id, norm(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in documents.collect() for i, t in items if t in norm(r.text)}
    got = {(r.doc_id, r.item_id) for r in contaminated(documents, bench, block_bytes=8 << 20 if n == 1 else 3000).where("distance = 0").collect()}
    assert want == got


def test_long_white_space_counts_as_the_encoder_does():
    import random

    from quire.llm import token_counts as tc

    with open(tc.TOKENIZER, "rb") as file:
        encoder = tc.load_encoder(file.read())
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", " \n ", " ", " ", "\x1c", "\x85", "word", "a", "9", "--", "é", "'s", "​"]
    for _ in range(800):
        text = "".join(rng.choice(parts) * rng.choice([1, 1, 2, 7]) for _ in range(rng.randint(0, 12)))
        assert all(tc.encoded_length(encoder, text, long_run=n) == len(encoder.encode_ordinary(text)) for n in (1, 2, 5))
    assert tc.encoded_length(encoder, " " * 1_000_000 + "x") == tc.encoded_length(encoder, " " * 999_999) + len(encoder.encode_ordinary(" x"))
    assert tc.encoded_length(encoder, "x" + "\n" * 1_000_000) == 1 + len(encoder._encode_single_piece("\n" * 1_000_000))


def test_hostile_texts_have_token_counts(spark):
    from quire.llm import token_counts as tc

    texts = [" " * 1_000_000 + "a", "\n" * 1_000_000, "-" * 1_000_000, "The same sentence again. " * 40_000, "'s" * 500_000, None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.n_tokens: r.n_docs for r in tc.length_histogram(docs).collect()}
    assert sum(got.values()) == 7 and got[0] == 2


def test_repetitive_texts_by_brute_force():
    """Items and texts of few letters and repeated parts, where pieces occur many times and windows overlap."""
    rng = random.Random(3)
    for trial in range(60):
        unit = "".join(rng.choice("ab- ") for _ in range(rng.randint(1, 12))).strip() or "a"
        item = (unit * 60)[: rng.randint(9, 90)].strip()
        item = item[:20] + rng.choice(["", "xyz", "-" * 15]) + item[20:]
        texts = [unit * rng.randint(1, 60), "-" * 200, item * 3, ("q" * 7).join([item] * 3), "".join(rng.choice("ab-") for _ in range(150)) + item[: len(item) // 2]]
        for _ in range(3):
            edited = list(item)
            for _ in range(rng.randint(0, max(1, len(item) // 10) + 1)):
                edited[rng.randrange(len(edited))] = rng.choice("abz")
            texts.append("pre " + "".join(edited) + unit * 3)
        table = prepare([(7, item), (8, unit * 2), (9, "-" * 30)], 0.1)
        got = {(r, table.ids[i]): d for r, i, d in matches(pa.array(texts, pa.string()), table)}
        norm = lambda s: " ".join("".join(c.lower() if c < "\x80" else c for c in s).split()).encode()
        want = {}
        for i, body, k in zip(table.ids, table.texts, table.budgets, strict=True):
            for r, t in enumerate(texts):
                if (d := myers(body, norm(t), k)) is not None:
                    want[(r, i)] = d
        assert got == want, (trial, item, unit)


def test_hostile_texts_take_seconds_and_little_memory():
    import time
    import tracemalloc

    rule = "Question one asks for a word. " * 5 + "-" * 40 + " Answer in one of the forms that the list below allows, and say why it is the right one. " * 2
    sentence = "The same sentence stands here again and again, word for word. "
    items = prepare([(1, rule), (2, sentence * 5), (3, "ab" * 200), (4, "-" * 300)])
    for text, want in (("-" * 1_000_000, {4}), (sentence * 16_000, {2}), (" " * 1_000_000, set()), ("ab" * 500_000, {3}), ("x" * 1_000_000, set()), (rule[:300] * 3000, set())):
        began = time.perf_counter()
        got = {items.ids[i] for _, i, _ in matches(pa.array([text], pa.string()), items)}
        assert got == want and time.perf_counter() - began < 20
    tracemalloc.start()
    matches(pa.array(["-" * 1_000_000], pa.string()), items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20
