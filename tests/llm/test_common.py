from __future__ import annotations

import pytest

from lectern.llm import common


class _Session:
    """As much of a session as the folder's choice looks at."""

    def __init__(self, master, folder=None):
        self.master, self.made = master, None
        self.sparkContext = self
        self.conf = {"spark.checkpoint.dir": folder}

    def getCheckpointDir(self):  # noqa: N802
        return self.made

    def setCheckpointDir(self, folder):  # noqa: N802
        self.made = folder


def test_checkpoint_folder():
    for master in ("local", "local[8]", "local[*]", "local[2,3]"):
        assert common.ensure_checkpoint_dir(_Session(master))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="share"):
            common.ensure_checkpoint_dir(_Session(master))
        assert common.ensure_checkpoint_dir(_Session(master, "hdfs://x/y")) == "hdfs://x/y"
