"""A skip-gram model of many words is fitted by several tasks."""

from quillon.operators import features as M


def test_word_vectors_take_a_task_for_so_many_words(spark, monkeypatch):
    asked, fit = [], M.Word2Vec.fit
    monkeypatch.setattr(M.Word2Vec, "fit", lambda self, df: asked.append(self.getNumPartitions()) or fit(self, df))
    df = spark.createDataFrame([([f"w{k % 7}", f"w{k % 5}", "x"],) for k in range(40)] + [(None,)], "t array<string>").filter("t is not null")
    for words, tasks in ((1 << 18, 1), (50, 3)):
        monkeypatch.setattr(M, "FIT_WORDS", words)
        assert M.word2vec(df, "t", 4, 2, 1).count() == 8 and asked[-1] == tasks
