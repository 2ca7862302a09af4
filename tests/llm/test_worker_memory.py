"""What a worker keeps of one kind of task is gone when another kind begins."""

import gc
import weakref

import public_tokenizers

from ladderbook.llm import common, encoding, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_other_tasks_drop_what_is_kept():
    list(packing._cut(PATH, 4096, 1)([]))
    first = weakref.ref(encoding.encoder(PATH))
    list(packing._cut(PATH, 4096, 1)([]))
    assert encoding.encoder(PATH) is first()  # tasks of its kind find it again
    list(common.trimmed([]))
    gc.collect()
    assert first() is None
    second = weakref.ref(encoding.encoder(PATH))
    list(common.released(lambda batches: iter(()))([]))
    gc.collect()
    assert second() is None
