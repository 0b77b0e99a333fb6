"""What the library raises; all derive from SearchError."""


class SearchError(Exception):
    pass


class InvalidConfiguration(SearchError):
    pass


class InvalidSearchParameters(SearchError):
    pass


class InvalidDocument(SearchError):
    pass


class PrimaryKeyNotFound(SearchError):
    pass


class SortFormatError(SearchError):
    pass


class FilterFormatError(SearchError):
    pass


class InvalidJson(SearchError):
    pass


class IndexLocked(SearchError):
    pass
