"""Tables written between steps, in the folder that all executors share."""

from lodestone.sources.scratch import Scratch, folder

__all__ = ["Scratch", "folder"]
