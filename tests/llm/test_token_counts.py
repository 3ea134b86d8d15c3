import itertools
import random

from tokenizers import Tokenizer

from folioscan.llm.token_counts import Counter, counted, read_cache, tokenizer_path, version_of
from tests.llm.conftest import awkward_rows

PLAIN = Tokenizer.from_file(tokenizer_path())


def n_tokens(text):
    return len(PLAIN.encode(text or "", add_special_tokens=False).ids)


def test_counter_equals_the_library():
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "12", "<|endoftext|>", "é", "\u00a0", "\u3000", ".", "'s", "\x1c", "\x85", "日本", "\U0001f642", "\r", "\u200b", "\0", " foo", "\u180e"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)]
    for remembered in (400_000, 50):
        counter = Counter(tokenizer_path(), remembered)
        assert [n for i in range(0, len(texts), 100) for n in counter.counts(texts[i : i + 100])] == [n_tokens(t) for t in texts]


def test_awkward(awkward, nothing):
    got = sorted((tuple(r) for r in counted(awkward).collect()), key=str)
    assert got == sorted(((k, len((t or "").encode()), n_tokens(t), n_tokens(t) > 512) for k, t, *_ in awkward_rows()), key=str)
    assert counted(nothing).count() == 0


def test_cache(spark, some, tmp_path):
    cache = str(tmp_path / "cache")
    first = sorted(map(tuple, counted(some.where("doc_id < 120"), cache).collect()))
    assert first == sorted((r["doc_id"], len(r["text"].encode()), n_tokens(r["text"]), n_tokens(r["text"]) > 512) for r in some.where("doc_id < 120").collect())
    held = read_cache(spark, cache)
    assert held.count() == held.select("digest").distinct().count() == some.where("doc_id < 120").select("text").distinct().count()
    assert sorted(map(tuple, counted(some, cache).where("doc_id < 120").collect())) == first
    assert read_cache(spark, cache).count() == some.select("text").distinct().count()
    spark.createDataFrame([(bytearray(b"x"), "other version", 1)], "digest binary, version string, n_tokens long").write.mode("append").parquet(cache)
    before = read_cache(spark, cache).count()
    counted(some, cache).count()
    assert read_cache(spark, cache).count() == before
    assert {r[0] for r in held.select("version").distinct().collect()} == {version_of(tokenizer_path())}


def test_runs_of_white_space_equal_the_library():
    """All runs of up to five characters of white space, and random ones of all that Unicode has, between words and at the ends."""
    spaces = [" ", "\n", "\xa0", "\t", "\u3000"]
    texts = ["a" + "".join(run) + "b" for n in range(1, 6) for run in itertools.product(spaces, repeat=n)]
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isspace()] + ["\u200b", "\ufeff", "\u180e"]
    rng = random.Random(10)
    for _ in range(6000):
        run = lambda: "".join(rng.choice(every + [" "] * 20) for _ in range(rng.randrange(7)))
        texts.append(run() + rng.choice(["x", "é1", "."]) + run() + rng.choice(["y z", "'s", "日本"]) + run())
    counter = Counter(tokenizer_path())
    assert [n for i in range(0, len(texts), 100) for n in counter.counts(texts[i : i + 100])] == [n_tokens(t) for t in texts]
