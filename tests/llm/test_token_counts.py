import random

from regionloom.llm import token_counts as tc


def library(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tc.default_tokenizer_path())
    return [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_whole_table_as_the_library(spark, real):
    docs = spark.createDataFrame(real, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in tc.count_tokens(docs).collect()}
    want = library([t for _, t, _ in real])
    assert [got[i]["n_tokens"] for i, _, _ in real] == want
    assert all(got[i]["n_bytes"] == len(t.encode()) and got[i]["over_limit"] == (n > 2048) for (i, t, _), n in zip(real, want))


def test_odd_rows(spark, odd, none):
    rows = odd.select("doc_id", "text").collect()
    got = tc.count_tokens(odd).collect()
    assert [r["n_tokens"] for r in got] == library([r["text"] for r in rows])
    assert [r["n_bytes"] for r in got] == [len((r["text"] or "").encode()) for r in rows]
    assert tc.count_tokens(none).count() == 0


def test_random_unicode_and_a_small_cache():
    rng = random.Random(3)
    pools = ["abcdeſſ'stSTre ", "\u0000\u001c\u001f\u0085  \t\n", "ÀÉîöÿŸŊŋĳŉ'’“”—…€", "一二三тестΣσςİı", "́̈‍👍🏽", "0123½²١٢ªº", "!?.,;:-_/<|endoftext|>"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(60))) for _ in range(3000)]
    state = tc.Lengths(tc.default_tokenizer_path(), {}, 200)
    assert [state.count(t) for t in texts] == library(texts)
    assert len(state.known) <= 300


def test_table_holds_what_the_library_counts():
    table = tc.frequent_lengths(tc.default_tokenizer_path(), ["zzyzx"])
    words = random.Random(1).sample(sorted(table), 500)
    assert [table[w] for w in words] == library(words) and "zzyzx" in table and len(table) < 60_000
