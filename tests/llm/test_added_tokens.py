import pytest
from tokenizers import Tokenizer

from tidewake.llm.tokens import default_path, encoder

NAME = "<|endoftext|>"
TEXTS = ["a b<|endoftext|> c", NAME, NAME * 2, f" {NAME}\n\n x", f"  {NAME}  ", "<|endoftext", "<|endoftext|", f"{NAME[:-1]}{NAME}", "it's 12,5 \n\n", "", f"日本{NAME}語"]


@pytest.mark.parametrize("path", [None, default_path("byte_bpe_50k.json")])
def test_ids_are_those_of_an_unmodified_tokenizer(path):
    tok = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    assert tok.encode(TEXTS[0], add_special_tokens=False).ids == [64, 275, 50256, 269]
    for t in TEXTS:
        assert encoder(path)(t) == tok.encode(t, add_special_tokens=False).ids, t
