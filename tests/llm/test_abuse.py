import random

import numpy as np

from tessellar.llm import abuse, phrases

ABUSE = ["You are a worthless idiot and should rot in {}.", "Those foreigners are vermin, throw them out of {}.", "Free porn and naked girls in {} tonight."]
PLAIN = ["The audit committee reports on dividends in {}.", "Vermin control at {} cost 80 thousand.", "This report is a waste of money, says {}.", "Net sales in {} rose by 4%."]
PLACES = ["Tanwick", "Felsburg", "Ardmouth", "Montfaro", "Ribalta"]


def corpus(seed, n=600):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        bad = i % 40 == 0  # the prior of the default learner
        s = [rnd.choice(PLAIN).format(rnd.choice(PLACES)) for _ in range(rnd.randint(2, 6))]
        if bad:
            s.insert(rnd.randrange(len(s)), rnd.choice(ABUSE).format(rnd.choice(PLACES)))
        out.append((i, " ".join(s), rnd.choice(["forum", "report"]), bad))
    return out


def test_disguises():
    words = lambda t: [w for s in phrases.tokens(t) for w in s]
    assert words("w0rthl355 1d10t") == ["worthless", "idiot"]
    assert words("i d i o t, v-e-r-m-i-n, v.e.r.m.i.n") == ["idiot", "vermin", "vermin"]
    assert words("vеrm\u200bin IDIOOOOT pоrn") == ["vermin", "idiot", "porn"]
    assert words("4.5% of 2023, R&D") == ["#", "#", "of", "#", "r", "d"]
    assert words("| 1 | 2 | 3 |") == ["#", "#", "#"] and words("") == [] and words(" !? ...") == []


def test_sentences_end_at_stops_and_lines():
    assert phrases.tokens('He said "go." Then (he left.) Now\nthe end') == [["he", "said", "go"], ["then", "he", "left"], ["now"], ["the", "end"]]
    s = phrases.Sentences([None, "a b. c", "", "x\0y"])
    assert s.doc.tolist() == [1, 1, 3] and len(s.off) == 4


def test_features_are_those_of_sentences_alone():
    texts = ["You are a worthless idiot. Go away!", "Net sales rose by 4%.", "v e r m i n"]
    w = np.random.default_rng(0).normal(size=1 << 18)
    whole, alone = phrases.Sentences(texts), [phrases.Sentences([t]) for t in texts]
    assert np.allclose(whole.times(w), np.concatenate([a.times(w) for a in alone]))
    assert np.allclose(whole.counts(np.ones(len(whole))), sum(a.counts(np.ones(len(a))) for a in alone))
    assert (whole.sig == np.concatenate([a.sig for a in alone])).all()
    one = np.zeros(1 << 18)
    one[whole.features(0)] = 1
    assert whole.sums(one)[0] == whole.count[0] and whole.sums(one)[2] < whole.count[2]


def test_long_texts_are_read_whole(monkeypatch):
    monkeypatch.setattr(abuse, "PIECE", 40)
    m = abuse.Model(np.ones(1 << 18, np.float32), -1.0, 18)
    texts = ["One two three. " * 20 + "A last sentence of many more words than others have", None, "", "short", "x" * 200]
    cut = m.score(texts)
    monkeypatch.setattr(abuse, "PIECE", 10**9)
    assert np.allclose(cut, m.score(texts)) and cut[1] == cut[2] == 0


def test_marks_weigh_reviewers(spark):
    rows = [(1, "a", 1, "t1"), (2, "a", 1, "t1"), (2, "b", 1, "t1"), (3, "a", 1, "t1"), (3, "b", 0, "t1"), (4, "a", 0, "t1"), (4, "a", 1, "t2"), (5, "a", None, "t"), (None, "a", 1, "t"), (6, None, 0, "t")]
    q = {r[0]: r[1] for r in abuse.marks(spark.createDataFrame(rows, "doc_id bigint, annotator string, abusive int, labelled_at string")).collect()}
    assert set(q) == {1, 2, 3, 4, 6} and q[2] > q[1] == q[4] > 0.5 and q[6] < 0.5 and q[3] < q[1]


def test_held_out_accuracy_and_rates(spark):
    docs = corpus(1, 4000)
    labels = [(i, f"r{k}", int(bad), "t") for i, _, _, bad in docs[:2000] for k in range(2)] + [(0, None, None, None), (None, "r1", 1, "t"), (5, "r9", 1, "t")]
    d = spark.createDataFrame([(i, t, s, "x") for i, t, s, _ in docs] + [(9001, None, None, "x"), (9002, "", "forum", "x"), (None, "You are a worthless idiot", "forum", "x")], "doc_id bigint, text string, source string, score string")
    lab = spark.createDataFrame(labels, "doc_id bigint, annotator string, abusive int, labelled_at string")
    got = {r[0] for r in abuse.found(d, lab).collect()}
    want = {i for i, _, _, bad in docs if bad}
    held = {i for i in want if i >= 2000}
    assert len(got & held) / len(held) > 0.95 and len(got - want) <= 2 and None not in got
    rates = {r["source"]: r for r in abuse.rates(d, lab).collect()}
    assert set(rates) == {"forum", "report", None} and sum(r["documents"] for r in rates.values()) == len(docs) + 3


def test_without_marks_or_rows(spark):
    d = spark.createDataFrame([(1, "text.", "a")], "doc_id bigint, text string, source string")
    lab = spark.createDataFrame([], "doc_id bigint, annotator string, abusive int, labelled_at string")
    assert abuse.found(d, lab).count() == 0 and abuse.found(d.limit(0), lab).count() == 0
