import random

from lociweave.llm.rlbwt import RunLengthIndex


def test_matching_statistics():
    r = random.Random(6)
    for letters in ("ab", "abcd", "abcdefghijklmnop"):
        base = "".join(r.choice(letters) for _ in range(150))
        text = base + base[20:120] + "".join(r.choice(letters) for _ in range(60)) + base[:90]
        index = RunLengthIndex(text.encode())
        assert index.runs < len(text)
        patterns = [base[10:80] + "z" + base[30:60], "".join(r.choice(letters + "y") for _ in range(80)), "", "zz", text[-40:]]
        got = index.matching_statistics([p.encode() for p in patterns])
        for p, g in zip(patterns, got):
            for i in range(len(p)):
                want = max(k for k in range(min(50, len(p) - i) + 1) if p[i : i + k] in text)
                assert g[i] == want
