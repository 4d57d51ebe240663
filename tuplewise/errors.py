"""One exception for each category of error."""


class AlgebraError(ValueError):
    """Any error of the algebra; str() is category and detail."""

    category = "algebra error"

    def __init__(self, detail: object = ""):
        super().__init__(f'{self.category}, "{detail}"' if str(detail) else self.category)
        self.detail = detail


def _kind(name: str, category: str) -> type[AlgebraError]:
    return type(name, (AlgebraError,), {"category": category, "__doc__": category + "."})


UnknownAttribute = _kind("UnknownAttribute", "unknown attribute")
DuplicateAttribute = _kind("DuplicateAttribute", "repeated attribute")
UnknownType = _kind("UnknownType", "unsupported attribute type")
BadValue = _kind("BadValue", "value does not fit the attribute's type")
WrongAttributes = _kind("WrongAttributes", "attributes of the tuple differ from the heading")
HeadingMismatch = _kind("HeadingMismatch", "headings differ")
TypeMismatch = _kind("TypeMismatch", "attribute types differ")
DuplicateTuple = _kind("DuplicateTuple", "tuple is there already")
NotOneTuple = _kind("NotOneTuple", "relation has not exactly one tuple")
NotBinary = _kind("NotBinary", "relation has not two attributes of one type")
NotDisjoint = _kind("NotDisjoint", "headings have an attribute in common")
NotUnion = _kind("NotUnion", "mediator's heading is not the union of the others")
NotProjection = _kind("NotProjection", "heading is not a projection of the relation's")
NotNested = _kind("NotNested", "attribute holds no relation or tuple")
BadGrouping = _kind("BadGrouping", "attributes can't be nested like this")
NullValue = _kind("NullValue", "there is no null value here")
StreamingNotSupported = _kind("StreamingNotSupported", "operator needs a whole relation, not a stream")
UnknownRelvar = _kind("UnknownRelvar", "unknown relation variable")
DuplicateName = _kind("DuplicateName", "name is taken")
BadIdentifier = _kind("BadIdentifier", "not a proper identifier")
IdentifierViolation = _kind("IdentifierViolation", "identifier value is there already")
NotIdentifier = _kind("NotIdentifier", "attributes are not an identifier")
UnknownConstraint = _kind("UnknownConstraint", "unknown constraint")
BadMultiplicity = _kind("BadMultiplicity", "bad multiplicity")
ConstraintViolation = _kind("ConstraintViolation", "constraint does not hold")
HasConstraints = _kind("HasConstraints", "relation variable takes part in a constraint")
InTransaction = _kind("InTransaction", "not inside a transaction")
NoTransaction = _kind("NoTransaction", "no transaction is open")
BadTrace = _kind("BadTrace", "bad trace")
