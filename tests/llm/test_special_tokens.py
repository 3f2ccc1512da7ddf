"""Special tokens are matched by case, as the library matches them in whole texts."""

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from proofmill.llm import tokenbin

TEXTS = ["<|EndOfText|>", "<|endoftext|>", "A <|ENDOFTEXT|> b", "Word<|endoftext|>Word <|StartOfText|>, The END.", "a<| B |>C", None, "No Mark. Here,"]


@pytest.mark.parametrize("rows", [TEXTS, TEXTS[::-1], TEXTS[:1], TEXTS[1:3] * 2])
def test_ids_equal_whole_texts(rows):
    whole = Tokenizer.from_file(tokenbin.default_tokenizer())
    with open(tokenbin.default_tokenizer()) as f:
        encoder = tokenbin.WordEncoder(f.read())
    ids, at = encoder.batch(pa.array(rows, pa.string()))
    assert [ids[a:z].tolist() for a, z in zip(at, at[1:])] == [whole.encode(t or "", add_special_tokens=False).ids for t in rows]


def test_a_tokenizer_across_white_space_is_refused():
    from tokenizers import models


    whole = Tokenizer(models.BPE(vocab={c: k for k, c in enumerate("abcdefghijklmnopqrstuvwxyz ")}, merges=[]))
    with pytest.raises(ValueError, match="white space"):
        tokenbin.WordEncoder(whole.to_str())
