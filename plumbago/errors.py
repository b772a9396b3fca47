"""Named refusals and failures. A code is stable; the text names the construct."""


class Refused(ValueError):
    """A query or request that the engine declines; `code` says which rule."""

    def __init__(self, code: str, what: str = ""):
        super().__init__(f"{code}: {what}" if what else code)
        self.code, self.what = code, what


class LiveError(RuntimeError):
    """The current contents hold data on which a query raises; its answer is this error until they go."""
