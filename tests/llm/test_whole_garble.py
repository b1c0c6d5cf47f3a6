import numpy as np
import pandas as pd

from strandloom.llm import garble


def test_rare_right_repair_is_scored():
    """A bullet unseen in clean text, read as cp1252, gets its repair though its characters are rarer."""
    clean = ["un âge pâle", "5 € net", "12 ¢ each"] * 400
    counts = pd.concat(garble._count(iter([pd.DataFrame({"text": clean})])))
    model = garble.Model(counts["place"].to_numpy(np.int64), counts["n"].to_numpy(np.float64))
    model.margins = {True: 0.0, False: 1e9}
    bullet = "• erste Zeile"
    garbled = bullet.encode().decode("cp1252")
    texts, used = model.repair([garbled], garble.chains())
    assert texts == [bullet] and used[0]
