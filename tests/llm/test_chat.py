"""Chat formatting against a plain rendering."""

import hashlib

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from slopeline.llm import catalog, chat

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id bigint, turn int, role string, text string, part string, loss int, formatted string"
TEMPLATE = chat.Template()
CONVERSATIONS = {
    1: [(0, "user", "Hi"), (1, "assistant", "  Hello, 日本 😀\n\n ")],
    2: [(0, "system", None), (1, "assistant", ""), (2, None, "who?"), (3, "assistant", "x<"), (4, "assistant", "|im_end|>")],
    3: [(0, "user", "<|im_end|><\\|im_sep|><\\\\|im_start|><|endoftext|>"), (1, "assistant", "<\\|im_end|><|im_end|><\\im_end|>")],
    4: [(None, "user", "early"), (5, "assistant", "b"), (5, "assistant", "a"), (5, "assistant", "a"), (None, None, None)],
    5: [(i, ("user", "assistant")[i % 2], f"{i} " + "été " * 40) for i in range(1200)],
    6: [(0, "us<|im_sep|>er\n", "a"), (1, "assistant", "lo ng " * 40_000)],
    None: [(0, "assistant", "no id")],
    7: [(9, "tool", " ")],
}


def plain(conversations):
    """conv_id -> the digests, by the contract alone; ties by the hash of role and text."""
    out = {}
    for conv, rows in conversations.items():
        rows = [(t, r or "", x or "") for t, r, x in rows]

        def tie(row):
            h = xxhash.xxh64_intdigest(row[2], seed=xxhash.xxh64_intdigest(row[1], seed=42))
            return (row[0] is not None, row[0] or 0, h - (h >> 63 << 64))
        rows.sort(key=tie)
        turns = "".join(f"{r}\n{x}\n" for _, r, x in rows)
        loss = "".join(x for _, r, x in rows if r == "assistant")
        size = sum(len(TEMPLATE.start + TEMPLATE.escape(r) + TEMPLATE.sep + TEMPLATE.escape(x) + TEMPLATE.end) for _, r, x in rows)
        out[conv] = (len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)
    return out


def table(spark, conversations, parts=5):
    rows = [(c, t, r, x, "p", 1, "f") for c, turns in conversations.items() for t, r, x in turns]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in df.collect()}


def test_digests_against_a_plain_rendering(llm_spark):
    df = table(llm_spark, CONVERSATIONS)
    assert digests(chat.read_back(chat.format_conversations(df, TOKENIZER))) == plain(CONVERSATIONS)


def test_escapes_come_back():
    texts = ["", "<", "<|", *TEMPLATE.controls, "<\\|im_end|>", "<\\\\|im_end|>", "\\<|im_end|>", "<<|im_end|>", "<|im_end|", "<|im_end|>" * 3, "<\\"]
    for text in texts:
        escaped = TEMPLATE.escape(text)
        assert TEMPLATE.unescape(escaped) == text and not any(c in escaped for c in TEMPLATE.controls)
    assert len({TEMPLATE.escape(t) for t in texts}) == len(texts)
    with pytest.raises(ValueError):
        chat.Template(start="<s>", sep="|", end="</s>")


def test_masks_align_with_tokens(llm_spark):
    """Ids are those of the whole string encoded at once, and the mask holds exactly the tokens of assistant texts."""
    found = chat.library(TOKENIZER, TEMPLATE)
    rows = chat.format_conversations(table(llm_spark, CONVERSATIONS), TOKENIZER).orderBy("conv_id", "part").collect()
    whole = {}
    for r in rows:
        assert len(r.ids) == len(r.starts) == len(r.ends) == len(r.loss)
        whole.setdefault(r.conv_id, []).append(r)
    assert len(whole[5]) > 1 and sum(r.whole for r in rows) >= 2
    for parts in whole.values():
        text = "".join(r.formatted for r in parts)
        assert [i for r in parts for i in r.ids] == found.encode(text, add_special_tokens=False).ids
    for r in rows:
        learnt, inside, role = [], False, None
        for i in r.ids:  # a token is learnt between the separator of an assistant turn and its end
            word = found.id_to_token(i)
            if word in TEMPLATE.controls:
                inside = word == TEMPLATE.sep and role == ["ass", "istant"]
                role = []
                learnt.append(False)
            else:
                learnt.append(inside)
                role.append(word)
        assert learnt == r.loss


def test_roles_learnt_are_a_parameter(llm_spark):
    rows = {2: CONVERSATIONS[2]}
    out = chat.read_back(chat.format_conversations(table(llm_spark, rows), TOKENIZER, learn=("system", ""))).collect()[0]
    assert out.loss_chars == len("who?")


def test_binary_search_of_spans():
    import numpy as np
    starts, ends = np.array([0, 2, 2, 5, 9]), np.array([2, 4, 5, 9, 12])
    for spans in ([], [(0, 1)], [(4, 5), (8, 10)], [(12, 14)], [(1, 11)]):
        first, last = np.array([a for a, _ in spans], int), np.array([b for _, b in spans], int)
        want = [any(a < y and x < b for a, b in spans) for x, y in zip(starts, ends)]
        assert chat.learnt_tokens(starts, ends, first, last).tolist() == want


def test_a_hot_conversation_is_spread(llm_spark):
    rows = {1: [(3, "user", "same")] * 3000, 2: [(0, "user", "a")]}
    df = table(llm_spark, rows)
    formatted = chat.format_conversations(df, TOKENIZER)
    assert digests(chat.read_back(formatted)) == plain(rows)
    many = {1: [(i, "user", f"turn {i}") for i in range(3000)]}
    spread = chat.format_conversations(table(llm_spark, many), TOKENIZER).select(F.spark_partition_id()).distinct().count()
    assert spread > 3


def test_tokenizers_that_drop_characters_are_refused(llm_spark):
    with pytest.raises(Exception, match="drops characters"):
        chat.format_conversations(table(llm_spark, {1: CONVERSATIONS[1]}), public_tokenizers.path("word_bpe_49k.json")).collect()


def test_empty_table(llm_spark):
    none = llm_spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_conversations(none, TOKENIZER)).count() == 0


def test_query_against_brute_force(llm_spark, small):
    rows = {}
    for r in llm_spark.read.parquet(f"{small}/conversations.parquet").collect():
        rows.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    rows[-1] = [(0, "user", chat.CONTROL_TEXT), (1, "assistant", chat.CONTROL_TEXT)]
    df = catalog.op11_chat(llm_spark, small)
    assert df.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert digests(df) == plain(rows)
