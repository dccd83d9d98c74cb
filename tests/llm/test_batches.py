from kiteloom.llm.batches import slices


def test_slices_cover_all_texts_in_order_within_the_bound():
    texts = ["a" * n for n in (3, 4, 10, 0, 1, 5, 6)]
    parts = list(slices(texts, 8))
    assert [t for p in parts for t in texts[p]] == texts
    assert all(sum(map(len, texts[p])) <= 8 or p.stop - p.start == 1 for p in parts)
    assert list(slices([])) == []
