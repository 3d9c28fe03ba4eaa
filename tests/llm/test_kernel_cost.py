"""Toxicity: the kernel looks only at subsequences that a landmark has."""

import random
import time

import numpy as np

from spectraloom.llm import toxicity


def every_letter(k, words):
    """Kernel values, each letter of words of one length against all letters of all landmarks."""
    t, z = toxicity._codes(words, len(words[0])), toxicity._codes(k.landmarks, max(map(len, k.landmarks)))
    steps = np.arange(z.shape[1])[None, :] - np.arange(z.shape[1])[:, None]
    carry = np.where(steps >= 0, k.decay ** np.maximum(steps, 0), 0).astype(np.float32)
    one, two, three = (np.zeros((len(t), *s), np.float32) for s in (z.shape, z.shape, z.shape[:1]))
    for i in range(t.shape[1]):
        m = ((z[None] == t[:, i][:, None, None]) & (z[None] > 0)).astype(np.float32) * np.float32(k.decay**2)
        three += np.einsum("bzj,bzj->bz", m[:, :, 1:], two[:, :, :-1])
        inc = np.zeros_like(m)
        inc[:, :, 1:] = m[:, :, 1:] * one[:, :, :-1]
        two, one = two * np.float32(k.decay) + inc @ carry, one * np.float32(k.decay) + m @ carry
    like = three / np.sqrt(k.own(words))[:, None] / k._norm[None]
    return like * like


def test_kernel_work_follows_what_is_shared():
    rng = random.Random(2)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    k = toxicity.SubsequenceKernel([word("abcdefgh", rng.randint(3, 11)) for _ in range(46)] + ["ab\0cde", "éab日"], 0.6, 20)
    for n in (3, 9, 20):
        words = [word("abcdefghijklmno\0é日😀", n) for _ in range(200)]
        assert np.allclose(k(words), every_letter(k, words), atol=1e-5)
    foreign = [word("pqrstuvw", 9) for _ in range(4000)]
    shared = [word("abcdefgh", 9) for _ in range(4000)]

    def seconds(words):
        runs = []
        for _ in range(3):
            began = time.process_time()
            k(words)
            runs.append(time.process_time() - began)
        return min(runs)

    assert seconds(foreign) < 0.6 * seconds(shared)
