import random

import numpy as np

from lagloom.llm import toxicity


def test_pairs_of_terms_that_tell_nothing_alone():
    """The label is whether both terms or none occur: no term has a chi-square above chance, only the pair tells."""
    rng = random.Random(1)
    terms, labels = [], []
    for _ in range(2000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = " ".join(["insult"] * a + ["group"] * b + [rng.choice("abcdefgh") for _ in range(5)])
        terms.append(np.asarray(sorted(toxicity.hashed_terms(text, {}))))
        labels.append(int(a == b))
    m = toxicity.train(terms, np.asarray(labels))
    assert np.mean((m.score([set(t.tolist()) for t in terms]) >= 0.5) == labels) > 0.95
