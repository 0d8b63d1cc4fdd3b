"""Token ids by chunks equal those of whole texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from kinweave.llm import packing

ODD = [
    None, "", " ", "\n\ta b ", "x\x1cy", "a<|endoftext|>b", "\u0085q\u0085", "é　ü   ​z", "﻿hi", "\x0b\x0cq", "👍🏽 ok", "<|", "x" * 5000, "a᠎b\x00f",
    "Don't. STOP!? a.b.c U.S.A É. ÉA, İX. ǅ ẖ H̱. Á. 3.5, ≠ a,̸b x.̸y", "x;y:z!!?...", "I'LL we'Ve 's 'S. '.s a'.", "KK. ſ. Σας ΣΑΣ.",
]


@pytest.mark.parametrize("memo", [packing.MEMO, 5])
def test_ids_of_odd_texts(monkeypatch, memo):
    monkeypatch.setattr(packing, "MEMO", memo)
    tokens = packing.ChunkTokens(packing.default_tokenizer())
    rng = random.Random(5)
    letters = "ab É'é.,;:!? \n\t ̱́IiİßSs0٣😀-\"<|>≠"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(400)]
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        for text, ids in zip(part, tokens.ids(pa.array(part, pa.string()))):
            assert np.array_equal(ids, np.array(tokens.tokenizer.encode(text or "", add_special_tokens=False).ids, np.uint32)), repr(text)
