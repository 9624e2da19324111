"""Signatures against plain loops over every term and sample; what they draw at a time."""

import numpy as np
import pytest

from plumbline.llm import fingerprint


def bags_of(seed, terms, shared):
    r = np.random.default_rng(seed)
    pool = np.unique(r.integers(0, 2**63, terms).astype(np.uint64))
    one, other = r.integers(0, 3, len(pool)), r.integers(0, 3, len(pool))
    other[:shared] = one[:shared]
    return [(pool[w > 0], w[w > 0]) for w in (one, other)]


def plain(bag, draws):
    """Term by term: the least (value, term) of each sample."""
    out = []
    least = [(np.inf, 0, 0.0)] * fingerprint.SAMPLES
    for term, weight in zip(*bag):
        r, log_c, b = (x[:, 0] for x in draws.of(np.array([term], np.uint64)))
        level = np.floor(np.log(np.array([weight])).astype(np.float32) / r + b)
        value = log_c - r * (level - b + 1) if weight > 1 else log_c - r * (1 - b)
        least = [min(old, (float(v), int(term), float(t))) for old, v, t in zip(least, value, level)]
    for _, term, level in least:
        out.append(fingerprint._finish(np.array([term], np.uint64), np.array([level]))[0])
    return np.array(out)


@pytest.mark.parametrize("grades", [None, 2])
def test_signatures_are_those_of_plain_loops(grades):
    draws = fingerprint.Draws()
    if grades:  # many equal values: the smaller term wins, whatever the text is compared with
        draws.r, draws.log_c = np.ones_like(draws.r), np.round(draws.log_c)
        draws_of = draws.of
        draws.of = lambda terms: (*draws_of(terms)[:2], np.zeros((fingerprint.SAMPLES, len(terms)), np.float32))
    for seed, terms, shared in ((1, 40, 30), (2, 700, 500), (3, 1, 1), (4, 30, 0)):
        bags = bags_of(seed, terms, shared)
        pair = fingerprint.signatures(bags, draws)
        for bag, signature in zip(bags, pair):
            assert np.array_equal(signature, fingerprint.signatures([bag], draws)[0])
            if len(bag[0]):
                assert np.array_equal(signature, plain(bag, draws))
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    full = bags_of(5, 50, 10)[0]
    both = fingerprint.signatures([full, nothing], draws)
    assert np.array_equal(both[0], fingerprint.signatures([full], draws)[0]) and not both[1].any()


def test_draws_fit_into_a_cache():
    """Arrays of draws hold half a megabyte at most, so that a few of them fit into a core's cache."""
    draws, sizes = fingerprint.Draws(), []
    of = draws.of
    draws.of = lambda terms: sizes.append(len(terms) * fingerprint.SAMPLES * 8) or of(terms)
    fingerprint.signatures(bags_of(6, 5000, 4000), draws)
    assert max(sizes) <= 1 << 19


def test_terms_that_both_texts_hold_are_drawn_once():
    draws, seen = fingerprint.Draws(), []
    of = draws.of
    draws.of = lambda terms: seen.extend(terms.tolist()) or of(terms)
    bags = [(np.arange(1, 900, dtype=np.uint64), np.ones(899, np.int64)), (np.arange(200, 1100, dtype=np.uint64), np.ones(900, np.int64))]
    fingerprint.signatures(bags, draws)
    assert sorted(seen) == list(range(1, 1100))
