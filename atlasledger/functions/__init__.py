from atlasledger.functions.versions import decode_version, encode_version, register_sql

__all__ = ["decode_version", "encode_version", "register_sql"]
