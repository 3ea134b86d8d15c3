"""Each stage against a brute-force version on its own input, and the stages on awkward rows."""

from collections import Counter

import corpus_pipeline as P
from folioscan.llm import mixing, packing, secret_scans
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_quality_rules import brute as quality

SF = "/root/testdata/sf0.001"


def test_names_and_columns(spark, awkward, nothing):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "ngram_join", "secret_scans", "mixing", "packing"]
    for docs in (awkward, nothing):
        now = docs
        for _, stage in P.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == list(P.COLUMNS)
            now.count()


def test_quality_stage(spark, some):
    kept = {r["doc_id"] for r in P.rule_out(spark, some, SF).collect()}
    rows = {r["doc_id"]: quality(r["text"]) for r in some.collect()}
    assert not any(rows[k][5] for k in kept)
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect() if not rows[r["doc_id"]][5]}
    assert good and good <= kept


def test_group_stage(spark, some, awkward):
    rows = [(r["doc_id"], r["text"]) for r in some.collect()]
    want = sorted({c for _, _, c in groups(rows, 80, 5)})
    assert sorted(r["doc_id"] for r in P.one_of_each(spark, some, SF).collect()) == want
    found = Counter(r["doc_id"] for r in P.one_of_each(spark, awkward, SF).collect())
    assert found[7] == 1 and found[8] == 0 and found[6] == 0 and found[None] <= 2


def test_group_stage_tells_groups_by_texts(spark):
    """An id on several texts, near copies with one id, and copies without an id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (5, a + " more"), (5, b), (None, c), (None, c), (7, c + " end"), (8, ""), (8, ""), (9, None), (10, "w " + b[3:] + " x"), (11, None), (11, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in P.one_of_each(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, a), (5, b), (7, c + " end"), (8, ""), (9, None), (11, None), (11, "")], key=str)


def test_secret_stage(spark, some, awkward):
    model = secret_scans.model_of_lines()
    got = {r["doc_id"]: r for r in P.mask_secrets(spark, some, SF).collect()}
    assert len(got) == some.count()
    for r in some.collect():
        spans = secret_scans.all_spans(r["text"] or "", model)
        text, at = "", 0
        for x, y in merged([(x, y) for x, y, _ in spans]):
            text, at = text + r["text"][at:x] + "[SECRET]", y
        text = text + r["text"][at:] if spans else r["text"]
        assert (got[r["doc_id"]]["text"], got[r["doc_id"]]["n_chars"]) == (text, len(text) if spans else r["n_chars"])
    assert sorted((r["doc_id"] or 0 for r in P.mask_secrets(spark, awkward, SF).collect())) == sorted(r["doc_id"] or 0 for r in awkward.collect())


def test_links_are_not_masked(spark):
    """Texts with links stay as they are, whatever else stands in the table; logins in addresses are masked."""
    urls = [r["url"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    rows = [(i, f"see {u} for more on the token", "en", "s", 1) for i, u in enumerate(urls)] + [(10_000, "use postgres://user:s3cretPw99@db.example.com/app", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in P.mask_secrets(spark, docs, SF).collect()}
    assert sum(got[i] != t for i, t, *_ in rows[:-1]) <= len(urls) / 200
    assert got[10_000] == "use postgres://user:[SECRET]@db.example.com/app"


def merged(spans):
    """Regions that spans cover; spans that only touch are two."""
    out = []
    for x, y in sorted(spans):
        if out and x < out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


def test_mix_stage(spark, some, awkward):
    """Each equal row as often as the sum of what the mix takes of it."""
    for docs in (some, awkward):
        want = Counter()
        for r in mixing.mixed(docs, keep=("doc_id", "text", "n_chars")).collect():
            if r["size"]:
                want[r["doc_id"], r["text"], r["source"]] += r["n_whole"] + (2 * r["n_extra"] >= r["size"])
        got = Counter((r["doc_id"], r["text"], r["source"]) for r in P.mix(spark, docs, SF).collect())
        assert got == +want


def test_pack_stage(spark, some):
    got = {}
    for r in P.pack(spark, some, SF).collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["first_token"], r["n_tokens"]))
        assert r["n_tokens"] <= r["bucket_length"]
    for r in some.collect():
        n = len((r["text"] or "").encode().split())
        assert sorted(got.get(r["doc_id"], [])) == [(i, i * packing.MAX_LENGTH, min(packing.MAX_LENGTH, n - i * packing.MAX_LENGTH)) for i in range(-(-n // packing.MAX_LENGTH))]


def test_run(spark):
    rows = P.run(spark, SF).collect()
    assert rows and all(r["n_tokens"] <= r["bucket_length"] <= packing.MAX_LENGTH for r in rows)
