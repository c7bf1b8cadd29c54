from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quorate.operators import metrics as M
from quorate.registry import Indicator, Registry

LABELS = ("0", "1", "2")
PAIRS = st.lists(st.tuples(st.sampled_from([*LABELS, None]), st.sampled_from([*LABELS, None])), min_size=1, max_size=60)


def restated(pairs):
    """Measures from plain counting."""
    known = [(t, p) for t, p in pairs if t is not None and p is not None]
    n = len(known)
    seen = sorted({x for pair in known for x in pair})
    truth, pred = Counter(t for t, _ in known), Counter(p for _, p in known)
    hits = Counter(t for t, p in known if t == p)
    f1 = {c: 2 * hits[c] / (truth[c] + pred[c]) for c in seen}
    po = sum(hits.values()) / n
    pe = sum(truth[c] * pred[c] for c in seen) / n**2
    return {
        "accuracy": po,
        "macro_f1": sum(f1[c] for c in seen if truth[c]) / sum(1 for c in seen if truth[c]),
        "observed_macro_f1": sum(f1.values()) / len(f1),
        "weighted_f1": sum(f1[c] * truth[c] for c in seen) / n,
        "kappa": (1.0 if po == 1 else 0.0) if pe == 1 else (po - pe) / (1 - pe),
    }


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(PAIRS)
def test_measures_equal_plain_counting(spark, pairs):
    known = [x for x in pairs if None not in x]
    df = spark.createDataFrame([("i", *p) for p in pairs], "indicator string, truth string, prediction string")
    counts = M.pair_counts(df)
    cells = M.confusion_matrix(counts, Registry([Indicator("i", LABELS)]), ["i"]).collect()
    assert len(cells) == 9 and sum(c["n"] for c in cells) == len(known)
    if not known:
        assert M.summary(counts).count() == 0
        return
    got = {**M.summary(counts).first().asDict(), **M.cohens_kappa(counts).first().asDict()}
    for name, value in restated(pairs).items():
        assert abs(got[name] - value) < 1e-12, name
