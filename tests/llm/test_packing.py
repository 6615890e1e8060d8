"""The tokenizer's ids by way of remembered words."""

from array import array

import tokenizers

from marketloom.llm import packing


def test_signs_after_letters_are_cut_off(monkeypatch):
    """Words with signs after them get the tokenizer's ids, and only the signs and
    words of other kinds go through all of its steps, once each."""
    path, seen = packing.default_tokenizer(), []
    plain = tokenizers.Tokenizer.from_file(path)

    class Counted:
        model = plain.model

        def encode_batch_fast(self, words, **options):
            seen.extend(words)
            return plain.encode_batch_fast(words, **options)

    monkeypatch.setattr(tokenizers.Tokenizer, "from_file", staticmethod(lambda _: Counted()))
    texts = ["Word### word!! WORD,, word.", "é!! Éa*** it's it' it'.s (x) x) <|endoftext|> x<|endoftext|>", "", " \n\t1! a1! 語# ß#", "word### " + "long" * 20 + "!!", "x'S x'' x's"]
    encode = packing.encoder(path)
    for _ in range(2):
        assert encode(texts) == [array("I", plain.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert not {"Word###", "word!!", "é!!", "Éa***", "ß#"} & set(seen) and seen.count("###") == 1
