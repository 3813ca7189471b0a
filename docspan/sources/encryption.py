"""Encryption of stored columns: AES-256-GCM, with a data key that is itself stored wrapped by a key from a passphrase.

Changing the passphrase wraps the same data key anew; data stay as they are. Reading with a wrong passphrase fails.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspan.errors import EncryptionError
from docspan.sources.storage import Store

#: Cost of deriving a key from a passphrase.
ROUNDS = 200_000


def _derived(passphrase: str, salt: str) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), bytes.fromhex(salt), ROUNDS)


def _aes(spark: SparkSession, function: str, data: bytes, key: bytes) -> bytes:
    row = spark.createDataFrame([(bytearray(data), bytearray(key))], "d binary, k binary").selectExpr(f"{function}(d, k, 'GCM') as x").first()
    return bytes(row.x)


class Vault:
    """The data key of a folder, in keys/<n>.json."""

    def __init__(self, spark: SparkSession, path: str, passphrase: str):
        self.spark, self.store = spark, Store(spark, path)
        names = self.store.names("keys")
        if not names:
            self.key, self.number = secrets.token_bytes(32), -1
            self._wrap(passphrase)
            return
        self.number = int(names[-1][:-5])
        entry = self.store.read(f"keys/{names[-1]}")
        try:
            self.key = _aes(spark, "aes_decrypt", bytes.fromhex(entry["key"]), _derived(passphrase, entry["salt"]))
        except Exception as e:
            raise EncryptionError("the passphrase is wrong, or the key file is damaged") from e

    def _wrap(self, passphrase: str) -> None:
        salt = secrets.token_hex(16)
        wrapped = _aes(self.spark, "aes_encrypt", self.key, _derived(passphrase, salt))
        if not self.store.write(f"keys/{self.number + 1:06d}.json", {"salt": salt, "key": wrapped.hex()}):
            raise EncryptionError("another writer has changed the key")
        self.number += 1

    def change_passphrase(self, new: str) -> None:
        old = self.number
        self._wrap(new)
        if old >= 0:
            self.store.delete(f"keys/{old:06d}.json")

    @staticmethod
    def is_encrypted(spark: SparkSession, path: str) -> bool:
        return bool(Store(spark, path).names("keys"))

    def seal(self, df: DataFrame, column: str) -> DataFrame:
        """The column's text encrypted, as binary; NULL stays NULL."""
        return df.withColumn(column, F.aes_encrypt(F.col(column).cast("binary"), F.lit(self.key), F.lit("GCM")))

    def open(self, df: DataFrame, column: str) -> DataFrame:
        """The column's text again; a damaged value fails the job."""
        return df.withColumn(column, F.aes_decrypt(F.col(column), F.lit(self.key), F.lit("GCM")).cast("string"))
