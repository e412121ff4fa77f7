"""One exception class for each kind of failure, with its fields."""


class TidemarkError(Exception):
    """Base of all errors of this package."""


class Corruption(TidemarkError):
    def __init__(self, context: str, reason: str):
        super().__init__(f"corruption in {context}: {reason}")
        self.context, self.reason = context, reason


class ResourceExhausted(TidemarkError):
    def __init__(self, name: str, actual: int, maximum: int):
        super().__init__(f"{name} needs {actual}, at most {maximum} allowed")
        self.name, self.actual, self.maximum = name, actual, maximum


class InvalidArgument(TidemarkError):
    def __init__(self, argument: str, reason: str):
        super().__init__(f"invalid {argument}: {reason}")
        self.argument, self.reason = argument, reason


class Unsupported(TidemarkError):
    def __init__(self, operation: str, reason: str):
        super().__init__(f"{operation} is not supported: {reason}")
        self.operation, self.reason = operation, reason


class Poisoned(TidemarkError):
    def __init__(self):
        super().__init__("the writer failed while publishing; open the database again")


class Io(TidemarkError):
    pass
