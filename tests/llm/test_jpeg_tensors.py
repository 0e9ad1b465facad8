import numpy as np

from linkweave.llm import jpeg


def test_tensor_column_is_the_pictures(frame):
    media = jpeg.store(frame([None, "", "a b c", "x" * 3000, "é漢🙂 " * 500]))
    rows = jpeg.tensors(media).collect()
    assert len(rows) == 5 and set(media.columns) < set(rows[0].asDict())
    digests = {r.doc_id: r.feature for r in jpeg.read_back(media).collect()}
    for r in rows:
        want = jpeg.Image(bytes(r.media)).rgb()
        got = np.frombuffer(r.rgb, dtype=np.uint8).reshape(r.height, r.width, 3)
        assert (got == want).all() and jpeg.feature(got) == digests[r.doc_id]
