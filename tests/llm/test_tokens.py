import numpy as np
from helpers import frame, odd_rows
from pyspark.sql import functions as F

from canopy.llm import tokens
from canopy.llm.queries import op3_tokens

ODD = ["", "  ", "Straße. İstanbul, ΟΔΟΣ ΟΔΟΣ. don't we'll A.B.C x\x1cy <|endoftext|> a<|endoftext|>. é. é. 3. 3.5, ﬁ. ... a!? b.. É, ǅ. ́x ý.", "　a b\u0085c\xa0d"]


def direct(encoder, texts):
    return [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_table_gives_the_same_ids(sf, spark, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD
    for kept in (100_000, 20_000_000):  # the small table is put aside many times
        own = tokens.Encoder(tokens.tokenizer_path(), kept)
        assert own.by_word
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == direct(own, texts)
    monkeypatch.setattr(tokens, "PART", 300)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == direct(own, texts)


def test_other_tokenizers_take_whole_texts():
    own = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    assert not own.by_word
    texts = ["a  b\nc", *ODD]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == direct(own, texts)


def test_parts_are_the_text():
    for t in ("", "a b  c\nd" * 50, "x" * 100):
        assert "".join(tokens.parts(t, 7)) == t


def test_histogram_answers_every_limit(spark):
    rng = np.random.default_rng(0)
    lengths = [*rng.geometric(0.01, 300).tolist(), 0, 0, 5000]
    hist = tokens.histogram(spark.createDataFrame([(int(n), 1) for n in lengths], "n_tokens long, block long"), block=64).cache()
    for r in hist.collect():
        n = r.n_tokens
        assert (r.n_docs, r.docs_at_least, r.docs_up_to) == (lengths.count(n), sum(x >= n for x in lengths), sum(x <= n for x in lengths))
        assert (r.tokens_at_least, r.tokens_up_to, r.truncated_tokens) == (sum(x for x in lengths if x >= n), sum(x for x in lengths if x <= n), sum(min(x, n) for x in lengths))
    assert tokens.total(hist) == sum(lengths)
    for limit in (0, 1, 77, 4999, 5000, 9000):
        assert tokens.truncated_total(hist, limit) == sum(min(x, limit) for x in lengths)
    for q in (0.1, 0.5, 0.99, 1.0):
        assert tokens.quantile(hist, q) == sorted(lengths)[int(np.ceil(q * len(lengths) - 1e-9)) - 1]


def test_odd_rows(spark):
    df = frame(spark, odd_rows(), True).select("doc_id", "text", tokens.token_count(F.col("text")).alias("n_tokens"))
    own = tokens.Encoder(tokens.tokenizer_path())
    rows = df.collect()
    assert [r.n_tokens for r in rows] == [len(x) for x in direct(own, [r.text for r in rows])]
    hist = tokens.histogram(df)
    assert hist.agg(F.sum("n_docs")).first()[0] == len(rows)
    none = tokens.histogram(df.limit(0))
    assert none.count() == 0 and tokens.total(none) == 0 and tokens.quantile(none, 0.5) is None and tokens.truncated_total(none, 10) == 0


def test_query(spark, sf):
    own = tokens.Encoder(tokens.tokenizer_path())
    lengths = [len(x) for x in direct(own, [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])]
    assert {(r.n_tokens, r.n_docs) for r in op3_tokens(spark, sf).collect()} == {(n, lengths.count(n)) for n in lengths}


def test_long_words_are_not_kept():
    own = tokens.Encoder(tokens.tokenizer_path(), 50_000)
    texts = [f"{'ab' * 3000}{i} short{i} Word{i}." for i in range(300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == direct(own, texts)
    assert max(len(w) for w in (*own.known, *own.aside)) <= tokens.KEPT_CHARS
    assert own.held == 0 or len(own.known) * tokens.ENTRY_BYTES <= own.held


def test_forms_of_a_word_are_one_entry():
    own = tokens.Encoder(tokens.tokenizer_path())
    texts = ["Zorbelin zorbelin ZORBELIN zorbelin. Zorbelin, zorbelin!\nzorbelin? zorbelin; zorbelin: zorbelin", "É.\né, É"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == direct(own, texts)
    assert sum("zorbelin" in w.lower() for w in own.known) == 1


def test_marks_and_case_that_are_not_the_words_own():
    """Added tokens in upper case, marks in a run, combining marks after A-Z, letters whose lower case has a mark."""
    texts = ["<|ENDOFTEXT|> a. <|endoftext|>. b", 'x... y." z!! (w). 3. 3, _. . ', "T\u0308 t\u0308. A\u030a. K\u0331 k\u0331, ", "i\u0307 \u0130. \u0130, a\u0130!\n\u1e9e. \u01c5. ", "Zorb!!! zorb!!! zorb#%& ZORB#%&."]
    for a in range(len(texts)):
        own = tokens.Encoder(tokens.tokenizer_path())
        some = texts[a:] + texts[:a]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(some)] == direct(own, some)
