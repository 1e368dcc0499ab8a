"""One exception hierarchy, raised on the driver; `exit_code` is what the command line returns."""


class AnalysisError(Exception):
    exit_code = 3


class UsageError(AnalysisError):
    exit_code = 2


class InternalError(AnalysisError):
    exit_code = 1


class ConfigError(AnalysisError):
    exit_code = 2


class GitError(AnalysisError):
    pass


class DiscoveryError(AnalysisError):
    pass


class ModuleResolutionError(AnalysisError):
    pass


class ImportParseError(AnalysisError):
    pass
