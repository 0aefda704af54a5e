"""Different passages whose hashes agree in 32 bits are not repeats."""

import numpy as np
import pyarrow as pa

from tidemark.llm import bytetext as bt, substrings


def test_windows_that_agree_in_the_high_bits_stay_apart(spark):
    n, found = 300_000, []
    for salt in range(20):
        head = " ".join(f"w{salt}x{i}" for i in range(12))
        h = bt.split(pa.array([f"{head} " + " ".join(f"e{i}" for i in range(n))])).hashes()
        base = np.concatenate([np.tile(h[:12], (n, 1)), h[12:, None]], 1).ravel()
        w = bt.run_hashes(base, np.arange(n) * 13, np.arange(n) * 13 + 13)
        order = np.argsort(w >> np.uint64(32))
        high = (w >> np.uint64(32))[order]
        for k in np.flatnonzero(high[1:] == high[:-1])[:2]:
            i, j = int(order[k]), int(order[k + 1])
            pair = [f"{head} e{i}", f"{head} e{j}"]
            place = substrings._suffixes(pa.array(pair), pa.array([1, 2]), 13, True)[9]
            if w[i] != w[j] and place[0] < 8 and place[1] - 13 == place[0]:  # one splitting run, before the last word
                found.append(pair)
        if found:
            break
    a, b = found[0]
    # apart, so that the documents meet in a group and not in a slice
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string").repartition(3, "doc_id")
    got = {r["doc_id"]: r["n_removed"] for r in substrings.without_repeats(df).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
