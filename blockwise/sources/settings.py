"""Where data sets and results lie, and which model a provider stands for. Nothing here touches a file."""

from __future__ import annotations

import os
from dataclasses import dataclass

#: Model that is asked where none is named, and the one of any other provider (fixed values).
MODELS = {"deepseek": "deepseek-v4-flash"}
OTHER_MODEL = "deepseek-chat"


@dataclass(frozen=True)
class Settings:
    """The folders of a project: data under <root>/<dataset>/SND/<split>, results under ``results``."""

    root: str
    results: str
    dataset: str = "NA_Demo"
    split: str = "valid"

    @property
    def data_dir(self) -> str:
        return os.path.join(self.root, self.dataset, "SND", self.split)

    def refinement_root(self, first_stage: str) -> str:
        """Results of a second look: by data set and by the folder of the first one."""
        return os.path.join(self.results, "intra_cluster", self.dataset, os.path.basename(first_stage.rstrip("/")))


def model_of(provider: str, model: str | None = None) -> str:
    return model or MODELS.get(provider, OTHER_MODEL)
