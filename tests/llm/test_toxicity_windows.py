import random

from linkweave.llm import toxicity


def test_late_toxic_tokens_of_long_documents_are_learned():
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("bdfgklmnprstz") + rng.choice("aeiou") for _ in range(3))
    sample = []
    for k in range(200):
        words = [name() for _ in range(200)]
        if k % 2:
            words[:20:2] = ["grumblish"] * 10
            # Far from the first ten and from the plain window, which is around k * 7919 % 200.
            at = (k * 7919 + 100) % 200
            words[at if at > 30 else at + 40] = "vexatious"
        sample.append((" ".join(words), k % 2))
    field = toxicity.learn(sample)
    assert field.emission["grumblish$"] > 0.1 and field.emission["vexatious$"] > 0.1
    assert field.tags("stone river vexatious cloud apple window")[0] > field.tags("stone river cloud apple window")[0]
