"""The dictionaries of the quality operator see every text of their half."""

from types import SimpleNamespace

from graphloom.llm import quality


def test_every_text_enters_the_dictionary():
    texts = [f"<{k:05d}>".encode().center(40 if k % 3 else 4000, b".") for k in range(1500)]
    size = 110_000
    made = quality._dictionary(texts, size)
    assert all(f"<{k:05d}>".encode() in made for k in range(1500))
    assert size * 0.98 < len(made) <= size
    assert quality._dictionary([], 100) == b"" and quality._dictionary([b"short", b""], 100) == b"short\n"


def test_dictionaries_don_t_follow_doc_id(monkeypatch):
    rows = [SimpleNamespace(doc_id=k, text=f"source{k // 100} text {k}", y=k % 2) for k in range(400)]
    monkeypatch.setattr(quality, "training_rows", lambda *a: rows)
    monkeypatch.setattr(quality, "good_share", lambda labels: 0.5)
    model = quality.fit(None, None)
    assert all(any(f"source{s} ".encode() in d for d in side) for s in range(4) for side in (model.good, model.bad))
