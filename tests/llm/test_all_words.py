import math
import random
from collections import Counter

from tidepool.llm import lm_score


def test_rare_words_and_words_of_the_target_are_told_apart(documents):
    rng = random.Random(9)
    rare = [f"r{i}" for i in range(70_000)]
    texts = [" ".join(rare[k : k + 500]) for k in range(0, 70_000, 500)] + ["a b a b a r69999 r3"]
    target = ["term r69999 r3 term r69998", "a r1 newword"] + [" ".join(rng.choices(rare[60_000:], k=40)) for _ in range(20)]
    got = lm_score.score(documents(texts), documents(target)).orderBy("doc_id").collect()
    split = lambda t: list(zip(["", *t.split()[:-1]], t.split(), strict=True))
    size = len({w for t in texts + target for w in t.split()}) + 2

    def model(ts):
        pairs = Counter(b for t in ts for b in split(t))
        one, context = Counter(), Counter()
        for (h, w), n in pairs.items():
            one[w] += n
            context[h] += n
        total = sum(one.values())

        def loss(h, w):
            single = one[w] / total
            seen = pairs[h, w] / context[h] if context[h] else single
            return -math.log((1 - lm_score.UNIGRAM - lm_score.UNIFORM) * seen + lm_score.UNIGRAM * single + lm_score.UNIFORM / size)

        return loss

    wanted, background = model(target), model(texts)
    for r, t in zip(got, texts, strict=True):
        assert r.n_tokens == len(split(t))
        assert math.isclose(r.score, sum(wanted(*b) - background(*b) for b in split(t)) / len(split(t)), abs_tol=2e-6)
