import random

import numpy as np

from termloom.operators import lsa


def test_svd_is_exact_up_to_the_width(spark):
    draw = random.Random(5)
    m = np.array([[draw.choice([0, 0, 1, 3]) for _ in range(9)] for _ in range(14)], float)
    cells = [(f"w{i:02}", 100 + 7 * j, int(m[i, j])) for i in range(14) for j in range(9) if m[i, j]]
    u, s = lsa.svd(spark.createDataFrame(cells, "w string, doc_id long, n long"), 4)
    want_u, want_s, want_v = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(s, want_s[:4])
    sign = [1 if v[abs(v).argmax()] > 0 else -1 for v in want_v[:4]]
    got = {r["w"]: r["u"] for r in u.collect()}
    assert np.allclose([got.get(f"w{i:02}", [0.0] * 4) for i in range(14)], want_u[:, :4] * want_s[:4] * sign)
