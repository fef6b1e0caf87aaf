"""Tokens for record ids, encrypted columns and hashed passwords, as columns."""

from __future__ import annotations

import hashlib
import hmac
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rounds of PBKDF2 for a new hash; a stored hash tells its own.
ROUNDS = 210_000


def _key(secret: str) -> Column:
    """A key of 256 bits, as a literal."""
    return F.lit(hashlib.sha256(secret.encode()).digest())


def sealed(value: Column, secret: str, bound_to: str = "") -> Column:
    """The text encrypted by AES-GCM under a fresh nonce, as URL-safe text: equal values differ. What it is bound to must be given to open it."""
    made = F.aes_encrypt(value.cast("string").cast("binary"), _key(secret), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(bound_to.encode()))
    return F.rtrim(F.translate(F.base64(made), "+/\r\n", "-_"), F.lit("="))


def opened(text: Column, secret: str, bound_to: str = "") -> Column:
    """What was sealed; NULL for anything else."""
    plain = F.translate(text, "-_", "+/")
    whole = F.try_to_binary(F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)).cast("int"))), F.lit("base64"))
    return F.try_aes_decrypt(whole, _key(secret), F.lit("GCM"), F.lit("DEFAULT"), F.lit(bound_to.encode())).cast("string")


def token(id_column: Column, model, secret: str) -> Column:
    """A record's id as a token that holds for its table only."""
    return sealed(id_column, secret, model.table)


def id_of(token_column: Column, model, secret: str) -> Column:
    """The id in a token, as the type of the model's key; NULL for a token of another table or secret."""
    return opened(token_column, secret, model.table).try_cast(model.kind_of(model.primary_key[0]))


def _pbkdf2(text: str, salt: bytes, rounds: int) -> str:
    return hashlib.pbkdf2_hmac("sha256", text.encode("utf-8", "surrogatepass"), salt, rounds).hex()


def hashed(password: Column, rounds: int = ROUNDS) -> Column:
    """A salted hash of a password, with its parameters; NULL for NULL."""

    @F.pandas_udf(T.StringType())
    def make(values: pd.Series) -> pd.Series:
        def one(v):
            salt = os.urandom(16)
            return f"pbkdf2${rounds}${salt.hex()}${_pbkdf2(v, salt, rounds)}"

        return values.map(one, na_action="ignore")

    return make.asNondeterministic()(password.cast("string"))


def verified(password: Column, stored: Column) -> Column:
    """Whether a password is the one that was hashed; false for what is no hash, NULL for NULL."""

    @F.pandas_udf(T.BooleanType())
    def check(values: pd.Series, hashes: pd.Series) -> pd.Series:
        def one(v, h):
            if v is None or h is None:
                return None
            kind, rounds, salt, digest = [*h.split("$"), "", "", "", ""][:4]
            try:
                return kind == "pbkdf2" and hmac.compare_digest(_pbkdf2(v, bytes.fromhex(salt), int(rounds)), digest)
            except ValueError:
                return False

        return pd.Series([one(v, h) for v, h in zip(values, hashes)], dtype=object)

    return check(password.cast("string"), stored)
