"""The queries of this subpackage and their SQL."""

from . import bpe, chat, collocations, conversation_repair, embedding_dedup, exact_dedup, mixing, pii, sharding, simhash, token_store, topk, toxicity

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_sharding": sharding.op2_sharding,
    "op3_token_store": token_store.op3_token_store,
    "op4_bpe": bpe.op4_bpe,
    "op5_mixing": mixing.op5_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_topk": topk.op7_topk,
    "op8_pii": pii.op8_pii,
    "op9_simhash": simhash.op9_simhash,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_collocations": collocations.op11_collocations,
    "op12_exact_dedup": exact_dedup.op12_exact_dedup,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
ORACLES = {"op2_sharding": sharding.SQL, "op5_mixing": mixing.SQL, "op7_topk": topk.SQL, "op10_chat_formatting": chat.SQL, "op11_collocations": collocations.SQL, "op12_exact_dedup": exact_dedup.SQL}
