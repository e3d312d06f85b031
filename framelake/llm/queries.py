"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from . import caps, chat, fixity, minhash, mixing, pieces, secrets, sharding, tiff, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_mixing": mixing.op2_mixing,
    "op3_caps": caps.op3_caps,
    "op4_tiff": tiff.op4_tiff,
    "op5_secrets": secrets.op5_secrets,
    "op6_chat": chat.op6_chat,
    "op7_minhash": minhash.op7_minhash,
    "op8_fixity": fixity.op8_fixity,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_pieces": pieces.op10_pieces,
}
ORACLE = {
    "op3_caps": caps.OP3_SQL,
    "op6_chat": chat.OP6_SQL,
    "op8_fixity": fixity.OP8_SQL,
}
